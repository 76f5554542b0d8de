"""Personal data replaced by surrogates, with DataFrame functions alone.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment cards, social security
numbers, secrets (access keys; values after password, token and the like) and names after
a title. Each entity has a type and a normal form; equal normal forms are one entity,
however they are written (coreference). Its surrogate follows from a keyed hash:

* digits stay digits and separators stay where they are; a card keeps its first digit and
  its Luhn remainder; a phone number keeps its country code; an IP address moves to the
  reserved block 240.0.0.0/4; an address moves to a host of example.com; letters keep
  their case and their script;
* a name keeps its title; each of its words has one surrogate, wherever it stands, so that a family name alone and in
  full names, and with any title, is one family. A word's surrogate has its script, and the gender of the titles that it comes with,
  if they agree. A full name that has a title somewhere in a document is also found in it without one.

Collision checks, over all entities at once (a name's words are entities, given and family names apart): no two entities of a type have one
surrogate, and no surrogate is itself an entity of the corpus. So a word that draws again does so in every name that has it. Those that fail, all but the least of
a clash, draw again, from a space that grows with each round for names, addresses and
secrets. After ``ROUNDS`` rounds what still clashes (a format with fewer values than the
corpus has entities) keeps its format and gets 32 hex digits of its keyed hash behind, which no
other has; so distinct entities stay distinct and the work always ends.

Only documents that hold an entity are joined; the others pass through. Entities are
summed up to distinct ones before any is drawn, so a common one costs no more than a rare
one. Defined cases: null texts stay null, empty ones empty; rows that repeat are treated alike; a
null doc_id is as good as any other; of clashing entities the least keeps the first draw;
a long text is searched whole; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Draws by format alone; what clashes after them is told apart by its hash.
ROUNDS = 6
MALE = ("Mr", "Herr", "Monsieur", "Señor", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "госпожа")
NEUTRAL = ("Dr", "Prof")
TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))

_ADDRESS = r"[\p{L}\p{N}._%+\-]"
EMAIL = rf"(?<!{_ADDRESS}){_ADDRESS}++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)+"
NAME = rf"(?<!\p{{L}})(?:{TITLES})\.?\s\p{{Lu}}[\p{{L}}'\-]++(?:\s\p{{Lu}}[\p{{L}}'\-]++)?"
SECRET = r"""(?<!\p{L})(?i:password|passwd|secret|token|api[_\-]?key)\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9_\-/+]{8,}|(?<![A-Za-z0-9])AKIA[0-9A-Za-z]{16}(?![A-Za-z0-9])"""
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"\+\d{1,3}[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<!\d)\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})(?!\d)"
ENTITY = "|".join((EMAIL, NAME, SECRET, IP, SSN, PHONE, CARD))
#: What every entity has; texts without it are not searched.
HINT = rf"[@0-9]|(?i:password|passwd|secret|token|api[_\-]?key)|(?:{TITLES})\.?\s\p{{Lu}}"

LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "áàâäãçéèêëíîïñóôöõúùûü"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
SYLLABLES = ("ba", "ber", "dal", "den", "fo", "gar", "hol", "jan", "ka", "len", "mor", "nes", "ol", "per", "ros", "tav")
CYRILLIC_SYLLABLES = ("ба", "вер", "дал", "зен", "ко", "лар", "мол", "не", "пав", "рос", "сем", "тол", "фед", "хар", "чер", "шал")
SECRET_SIGNS = ("_", "-", "/", "+")
TYPES = ("email", "given", "family", "secret", "ip", "ssn", "phone", "card")
ENDINGS = {"latin": {"f": "a", "m": "o", "": "e"}, "cyrillic": {"f": "ана", "m": "ий", "": "я"}}
FAMILY_ENDINGS = {"f": "ова", "m": "ов", "": "ов"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def typed(raw: Column) -> Column:
    return (
        F.when(raw.contains("@"), "email").when(raw.rlike(rf"^(?:{TITLES})\.?\s\p{{Lu}}"), "name").when(raw.rlike("^[A-Za-z]"), "secret").when(raw.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(raw.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone").otherwise("card")
    )


def gender(raw: Column) -> Column:
    """f or m by the title of a name, or nothing."""
    title = F.regexp_extract(raw, rf"^({TITLES})", 1)
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("")


def _secret_lead(raw: Column) -> Column:
    """What stands before the value of a secret."""
    return F.regexp_extract(raw, r"""^([A-Za-z_\-]+\s*[=:]\s*["']?)""", 1)


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^((?:{TITLES})\.?\s)", 1)


def _after(raw: Column, lead: Column) -> Column:
    return raw.substr(F.length(lead) + 1, F.length(raw))


def normal(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "name", F.lower(F.regexp_replace(_after(raw, _title(raw)), r"\s+", " ")))
        .when(kind == "secret", _after(raw, _secret_lead(raw)))
        .when(kind == "ip", raw)
        .when(kind == "phone", F.right(_digits(raw), F.lit(10)))
        .otherwise(_digits(raw))
    )


def _draw(h: Column, i: Column) -> Column:
    """A number from 0 to 255 and more, of the hash h at place i (from 0)."""
    pair = F.conv(F.substr(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return pair + (i / 64).cast("int") * 7


def _pick(pool: str, n: Column) -> Column:
    return F.substr(F.lit(pool), F.pmod(n, F.lit(len(pool))) + 1, F.lit(1))


def _like(value: Column, h: Column, signs: bool = False) -> Column:
    """value with each letter and digit drawn anew, of the same class, case and script; if signs, those of secrets as well."""

    def one(c: Column, i: Column) -> Column:
        n, low = _draw(h, i), F.lower(c)
        drawn = (
            F.when(low.rlike("^[a-z]$"), _pick(LATIN, n)).when(c.rlike("^[0-9]$"), _pick("0123456789", n))
            .when(low.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC, n)).when(low.rlike(r"^\p{IsLatin}$"), _pick(ACCENTED, n))
            .when(c.isin(*SECRET_SIGNS) & F.lit(signs), _pick("".join(SECRET_SIGNS), n)).otherwise(c)
        )
        return F.when(c == low, drawn).otherwise(F.upper(drawn))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Remainder of the Luhn sum."""
    reverse = F.split(F.reverse(digits), "")

    def weighted(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(reverse, weighted), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _card(norm: Column, h: Column) -> Column:
    body = F.concat(F.left(norm, F.lit(1)), F.substr(_like(norm, h), F.lit(2), F.length(norm) - 2))
    return F.concat(body, F.pmod(_luhn(norm) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _stem(kind: Column, word: Column, h: Column, attempt: Column) -> Column:
    """Syllables for a word of a name, by its script, one more in each round; a family name has two more."""

    def built(pool: tuple[str, ...]) -> Column:
        syllable = lambda k: F.get(F.array(*map(F.lit, pool)), F.pmod(_draw(h, k), F.lit(len(pool))))
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda k: syllable(k + 3)), "")).otherwise("")
        return F.concat(syllable(F.lit(0)), syllable(F.lit(1)), more, F.when(kind == "family", F.concat(syllable(F.lit(2)), syllable(F.lit(3)))).otherwise(""))

    return F.when(word.rlike(r"\p{IsCyrillic}"), built(CYRILLIC_SYLLABLES)).otherwise(built(SYLLABLES))


def ended(kind: Column, form: Column, word: Column, stem: Column) -> Column:
    """stem with the ending of its form (f, m or nothing); all but names stay."""
    of = lambda endings: F.element_at(F.create_map(*[F.lit(x) for kv in endings.items() for x in kv]), form)
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    given = F.when(cyrillic, of(ENDINGS["cyrillic"])).otherwise(of(ENDINGS["latin"]))
    return F.when(kind == "given", F.concat(stem, given)).when((kind == "family") & cyrillic, F.concat(stem, of(FAMILY_ENDINGS))).otherwise(stem)


def drawn(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a normal form, itself in normal form; of a name's word its stem."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)
    # from the second round on an address or secret is longer
    grown = lambda v, signs=False: F.concat(_like(v, h, signs), _like(F.repeat(F.lit("a"), 3 * attempt), F.reverse(h)))
    ip = F.concat_ws(".", *[(F.lit(240 if i == 0 else 1) + F.pmod(_draw(h, F.lit(i)), F.lit(15 if i == 0 else 254))).cast("string") for i in range(4)])
    local = F.substring_index(norm, "@", 1)
    host = F.regexp_extract(norm, r"@([^.]+)", 1)
    return (
        F.when(kind == "email", F.concat(grown(local), F.lit("@"), _like(host, F.reverse(h)), F.lit(".example.com")))
        .when(kind.isin("given", "family"), _stem(kind, norm, h, attempt))
        .when((kind == "secret") & norm.startswith("AKIA"), F.concat(F.lit("AKIA"), _like(F.substr(norm, F.lit(5)), h)))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), F.left(F.repeat(h, 8), F.length(norm)))
        .when(kind == "secret", grown(norm, True))
        .when(kind == "ip", ip)
        .when(kind == "card", _card(norm, h))
        .otherwise(_like(norm, h))
    )


def rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate as raw was written."""
    chars, digits = F.split(raw, ""), _digits(raw)
    drawn_digits = F.regexp_extract(surrogate, "^[0-9]*", 0)
    skip = F.greatest(F.length(digits) - F.length(drawn_digits), F.lit(0))

    def digit(c: Column, i: Column) -> Column:
        at = F.length(_digits(F.substr(raw, F.lit(1), i + 1))) - skip
        return F.when(c.rlike("^[0-9]$") & (at > 0), F.substr(drawn_digits, at, F.lit(1))).otherwise(c)

    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(F.array_join(F.transform(chars, digit), ""), _after(surrogate, drawn_digits)))
        .when(kind == "secret", F.concat(_secret_lead(raw), surrogate))
        .when(kind == "name", F.concat(_title(raw), surrogate))
        .when((kind == "email") & (raw == F.upper(raw)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for the distinct entities (kind, norm, and form for names): no clash with one another or with an entity."""
    entities = entities if "form" in entities.columns else entities.withColumn("form", F.lit(""))
    settled = None
    known = entities.select("kind", F.lower("norm").alias("taken")).distinct()
    waiting = entities.select("kind", "norm", "form")
    draw = lambda attempt: ended(F.col("kind"), F.col("form"), F.col("norm"), drawn(F.col("kind"), F.col("norm"), F.lit(attempt), key))
    for attempt in range(ROUNDS):
        new = waiting.withColumn("surrogate", draw(attempt)).withColumn("taken", F.lower("surrogate"))
        all_ = new.withColumn("old", F.lit(1)) if settled is None else new.withColumn("old", F.lit(1)).unionByName(settled.withColumn("old", F.lit(0)))
        # of those that share a surrogate one stays: a settled one, else the least
        first = all_.groupBy("kind", "taken").agg(F.min(F.struct("old", "norm")).alias("first"))
        checked = all_.join(first, ["kind", "taken"]).join(known.withColumn("real", F.lit(True)), ["kind", "taken"], "left")
        ok = (F.col("first.norm") == F.col("norm")) & F.col("real").isNull()
        checked = common.stored(checked.withColumn("ok", ok).select("kind", "norm", "form", "surrogate", "taken", "ok"), "pii_drawn")
        settled, waiting = checked.where("ok").drop("ok"), checked.where("not ok").select("kind", "norm", "form")
        if waiting.isEmpty():
            break
    last = F.left(F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm"), 256), F.lit(32))
    rest = waiting.select("kind", "norm", F.concat(draw(0), F.lit("-"), last).alias("surrogate"))
    return settled.select("kind", "norm", "surrogate").unionByName(rest)


def name_words(raws: DataFrame) -> DataFrame:
    """(raw, at, kind, norm, gender) of each word of the names in raws (raw, kind, norm)."""
    words = F.split("norm", " ")
    rows = raws.where("kind = 'name'").select("raw", F.size(words).alias("n"), F.posexplode(words).alias("at", "norm"), gender(F.col("raw")).alias("gender"))
    return rows.select("raw", "at", F.when(F.col("at") == F.col("n") - 1, "family").otherwise("given").alias("kind"), "norm", "gender")


def distinct_entities(raws: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, norm, form): what is drawn for. A word's form is the gender of its titles, where all that have one agree."""
    has = lambda g: F.bool_or(F.col("gender") == g)
    form = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("")
    own = words.groupBy("kind", "norm").agg(has("f").alias("f"), has("m").alias("m")).select("kind", "norm", form.alias("form"))
    return raws.where("kind <> 'name'").select("kind", "norm", F.lit("").alias("form")).distinct().unionByName(own)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs as ``_row`` with new_text and n_entities; key is the caller's secret."""
    # a document's map is found by 128 bits of its id and text
    rows = common.packed(docs, _text=F.col("text"), _k=F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "doc_id").alias("b")))
    hinted = F.coalesce(F.col("_text").rlike(HINT), F.lit(False))
    found = F.regexp_extract_all(F.col("_text"), F.lit(ENTITY), F.lit(0))
    seen = common.stored(rows.where(hinted).select("_k", F.explode_outer(F.array_distinct(found)).alias("raw")).where("raw is not null"), "pii_found")
    raws = common.stored(seen.groupBy("raw").agg(F.count("*").alias("n")).select("raw", typed(F.col("raw")).alias("kind")).withColumn("norm", normal(F.col("kind"), F.col("raw"))), "pii_raws")
    words = name_words(raws)
    drawn_ = common.stored(surrogates(distinct_entities(raws, words), key), "pii_surrogates")
    others = raws.where("kind <> 'name'").join(drawn_, ["kind", "norm"]).select("raw", "kind", "surrogate")
    named = words.join(drawn_, ["kind", "norm"]).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("ws"))
    named = named.select("raw", F.lit("name").alias("kind"), F.array_join(F.transform("ws", lambda w: F.initcap(w["surrogate"])), " ").alias("surrogate"))
    # a full name as it stands behind its title
    bare = F.when((F.col("kind") == "name") & F.contains("surrogate", F.lit(" ")), F.struct(_after(F.col("raw"), _title(F.col("raw"))).alias("name"), F.col("surrogate").alias("new")))
    both = others.unionByName(named)
    shown = common.stored(both.select("raw", rendered(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("shown"), bare.alias("bare")), "pii_shown")
    # stored, so that the join is free to split rows that repeat
    maps = common.stored(seen.join(shown, "raw").groupBy("_k").agg(F.map_from_entries(F.collect_set(F.struct("raw", "shown"))).alias("_map"), F.array_sort(F.collect_set("bare")).alias("_bare")), "pii_maps")
    kept = rows.where(~hinted).select("_row", F.col("_text").alias("new_text"), F.lit(0).cast("long").alias("n_entities"))
    joined = rows.where(hinted).join(maps, "_k", "left").withColumn("_found", F.when(F.col("_map").isNotNull(), found))
    joined = joined.withColumn("_between", F.split(F.col("_text"), ENTITY, -1))
    between = F.col("_between")
    pattern = lambda e: F.concat(F.lit(r"(?<!\p{L})"), F.regexp_replace(e["name"], r"\s", r"\\s+"), F.lit(r"(?!\p{L})"))
    untitled = lambda text: F.aggregate("_bare", text, lambda t, e: F.regexp_replace(t, pattern(e), e["new"]))
    some = F.size("_bare") > 0
    clean = F.when(some, F.transform(between, untitled)).otherwise(between)
    again = F.aggregate(between, F.lit(0), lambda n, text: n + F.aggregate("_bare", F.lit(0), lambda k, e: k + F.regexp_count(text, pattern(e))))
    pieces = F.zip_with(clean, F.col("_found"), lambda a, b: F.concat(a, F.coalesce(F.element_at("_map", b), F.lit(""))))
    changed = joined.select(
        "_row",
        F.when(F.col("_map").isNull(), F.col("_text")).otherwise(F.array_join(pieces, "")).alias("new_text"),
        (F.coalesce(F.size("_found"), F.lit(0)) + F.when(some, again).otherwise(0)).cast("long").alias("n_entities"),
    )
    return kept.unionByName(changed.withColumn("n_entities", F.greatest("n_entities", F.lit(0).cast("long"))))
