"""A cuckoo filter over 64-bit hashes, with numpy operations on whole batches."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; 0 is an empty slot.

    ``add`` and ``remove`` take batches of hashes. What finds no slot after many
    evictions is kept whole in ``stash``, so there are no false negatives; who keeps
    filters builds them anew with more room before that becomes common. Removing a hash that was not added is an error of
    the caller; the exact reference counts guard against it.
    """

    def __init__(self, n_buckets: int, table: np.ndarray | None = None, stash: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    @classmethod
    def sized(cls, n_items: int) -> CuckooFilter:
        """Room for n_items at a load of at most 0.8; the number of buckets is a power of two."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n_items) / (0.8 * SLOTS))))))

    @property
    def load(self) -> float:
        """Share of the slots that are taken; what is stashed counts with them."""
        return (np.count_nonzero(self.table) + len(self.stash)) / self.table.size

    def to_bytes(self) -> bytes:
        return np.array([self.n, len(self.stash)], np.uint64).tobytes() + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        n, k = (int(x) for x in np.frombuffer(blob, np.uint64, 2))
        end = 16 + n * SLOTS * 2
        return cls(n, np.frombuffer(blob, np.uint16, n * SLOTS, 16).reshape(n, SLOTS).copy(), np.frombuffer(blob, np.uint64, k, end).copy())

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.n - 1)).astype(np.int64)
        return fp, first, self._other(fp, first)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((fp.astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(h)
        found = (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)
        return found | np.isin(h, self.stash) if len(self.stash) else found

    def _settle(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints in free slots of their buckets; returns which found one."""
        order = np.argsort(at, kind="stable")
        runs = at[order]
        starts = np.r_[True, runs[1:] != runs[:-1]] if len(runs) else np.zeros(0, bool)
        rank = np.arange(len(runs)) - np.maximum.accumulate(np.where(starts, np.arange(len(runs)), 0))
        empty = self.table[runs] == 0
        slot_of = np.argsort(~empty, axis=1, kind="stable")  # free slots first
        ok = rank < empty.sum(1)
        chosen = slot_of[np.arange(len(runs))[ok], rank[ok]]
        self.table[runs[ok], chosen] = fp[order[ok]]
        done = np.zeros(len(at), bool)
        done[order[ok]] = True
        return done

    def add(self, h: np.ndarray) -> None:
        fp, at, other = self._places(h)
        left = ~self._settle(fp, at)
        left[np.flatnonzero(left)] = ~self._settle(fp[left], other[left])
        fp, at, whole = fp[left], other[left], h[left]
        if not len(fp):
            return
        rng = np.random.default_rng(len(h))
        keep = self.table.copy()
        for _ in range(200):
            # one eviction a bucket and round: the newcomer takes a random slot, the old one moves on
            _, lead = np.unique(at, return_index=True)
            slots = rng.integers(0, SLOTS, len(lead))
            out = self.table[at[lead], slots]
            self.table[at[lead], slots] = fp[lead]
            rest = np.setdiff1d(np.arange(len(fp)), lead)
            fp = np.concatenate([out, fp[rest]])
            at = np.concatenate([self._other(out, at[lead]), at[rest]])
            done = self._settle(fp, at) | (fp == 0)
            fp, at = fp[~done], at[~done]
            if not len(fp):
                return
        self.table = keep
        self.stash = np.concatenate([self.stash, whole])

    def remove(self, h: np.ndarray) -> None:
        for one in h:
            x = np.array([one], np.uint64)
            stashed = np.flatnonzero(self.stash == one)
            if len(stashed):
                self.stash = np.delete(self.stash, stashed[0])
                continue
            fp, a, b = self._places(x)
            for at in (a[0], b[0]):
                slot = np.flatnonzero(self.table[at] == fp[0])
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break
