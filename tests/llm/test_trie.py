import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from reviewlake.llm import q_trie, trie

TURNS = "conv_id long, turn int, role string, text string, path string, words string, key string"


def sequences(rows):
    """{conv_id: [(role, text)]} of rows (conv_id, turn, role, text) without ties."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return out


def rebuilt(convs):
    return {c: convs.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + ts[zlib.crc32(str(c).encode()) % 4 :] for c, ts in convs.items()}


def brute(convs):
    """Rows of every node, by definition."""
    members = defaultdict(list)
    for c, ts in sorted(convs.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        out, waiting = [], [p]
        while waiting:
            out.append(waiting.pop())
            waiting += kids[out[-1]]
        return out

    words = lambda t: len(t.replace("\x0b", " ").encode().split())
    own = {p: (len(m) - 1) * words(p[-1][1]) if p else 0 for p, m in members.items()}
    rows = []
    for p, m in members.items():
        under = below(p)
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        rows.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), sum(not kids[x] for x in under), sum(own[x] for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "w", "k") for r in rows], TURNS)


def talk(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if t else None, rng.choice(["user", None]), rng.choice(["a b", "a b c", "", None, "x", "é \t z"])))
    rows += [(500 + c, t, "user", "same words here") for c in range(60) for t in range(9)]  # copies
    rows += [(40 * c, t, "user", "same words here") for c in range(100, 110) for t in range(2)]
    rows += [(9000, t, "user", f"turn {t}") for t in range(150)] + [(None, 1, "user", "no conversation")] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force_and_sql(spark, tmp_path, seed):
    rows = talk(seed)
    frame(spark, rows).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, q_trie.op13_trie(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert got == brute(rebuilt(sequences(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(q_trie.ORACLE["op13_trie"]).fetchall(), key=lambda r: r[:2]) == got


@pytest.mark.parametrize("turns", [1, 3, 40, 1000])
def test_any_size_of_shards(spark, turns):
    rows = talk(7, 60)
    got = sorted(map(tuple, trie.nodes(trie.paths(frame(spark, rows)), turns).collect()), key=lambda r: r[:2])
    assert got == brute(sequences(rows))


def test_turns_of_one_number_go_by_their_digest(spark):
    rows = [(c, 1, "user", t) for c in (1, 2, 3) for t in ("one", "two", "one")]
    got = trie.paths(frame(spark, rows).repartition(6)).collect()
    assert len(got) == 3 and len({bytes(r.path) for r in got}) == 1 and len(got[0].path) == 48
    assert trie.nodes(trie.paths(frame(spark, rows))).count() == 4


def test_no_conversations_and_a_turnless_one(spark):
    assert trie.nodes(trie.paths(frame(spark, []).where("false"))).count() == 0
    assert trie.nodes(trie.paths(frame(spark, [(None, 1, "user", "x")]))).count() == 0
    one = spark.createDataFrame([(7, bytearray(), [])], "conv_id long, path binary, words array<int>")
    assert tuple(trie.nodes(one).first()) == (7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())


def test_search_tree_is_balanced_and_takes_long_paths():
    tree = trie.SearchTree()
    for k in trie.by_medians(1023):
        tree.way([k])
    depth = {tree.down[0]: 1}
    for at in list(range(1, 1024)):
        for side in (tree.low, tree.high):
            if side[at] >= 0:
                depth[side[at]] = depth[at] + 1
    assert max(depth.values()) == 10 and sorted(trie.by_medians(7)) == list(range(7))
    assert len(trie.SearchTree().way(list(range(100_000)))) == 100_001


def test_common_turns():
    a, b = bytes(16) + b"x" * 16, bytes(16) + b"x" * 15 + b"y"
    assert [trie.common_turns(*p) for p in ((a, a), (a, b), (a, b""), (None, a), (a, None), (a, a + b))] == [2, 1, 0, 2, 2, 2]
