"""Repository text: lines, an inverted index, symbol search and requests for lists, ranges and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import action_path, is_test_path, stem
from ..functions.text import py_splitlines
from . import ordered
from .ordered import few, running, stored

TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*"


def source_lines(blobs: DataFrame) -> DataFrame:
    """(blob_sha, line_no, text) of each distinct blob: a file that many commits share is split once."""
    one = blobs.select("blob_sha", "content").dropDuplicates(["blob_sha"])
    return one.select("blob_sha", F.posexplode(py_splitlines(F.col("content"))).alias("i", "text")).select("blob_sha", (F.col("i") + 1).alias("line_no"), "text")


def token_index(lines: DataFrame) -> DataFrame:
    """(commit_sha, token, path, line_no, text) for lines (commit_sha, path, line_no, text); write it bucketed by token to search it often."""
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    return lines.select("commit_sha", F.explode(tokens).alias("token"), "path", "line_no", "text")


def symbol_search(index: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """First ``limit`` lines, by path and line, of each (commit_sha, symbol) that holds it as a whole word.

    Postings of the wanted tokens are cut to the limit before they fan out to those that asked.
    """
    wanted = symbols.select("commit_sha", F.col("symbol").alias("token")).distinct()
    hits = index.join(wanted, ["commit_sha", "token"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("commit_sha", "token").orderBy("path", "line_no"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnRenamed("token", "symbol")
    return symbols.join(hits, ["commit_sha", "symbol"])


def symbol_lines(lines: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """``symbol_search`` in lines (commit_sha, path, line_no, text) without an index of them: two passes over the lines.

    Lines are not copied for each of their tokens: places alone are dealt out, those of wanted tokens, and only the lines that are shown come with their text.
    """
    wanted = few(symbols.select("commit_sha", F.col("symbol").alias("token")).distinct())
    places = token_index(lines).drop("text").join(wanted, ["commit_sha", "token"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("commit_sha", "token").orderBy("path", "line_no"))
    hits = stored(places.withColumn("rank", rank).where(F.col("rank") <= limit).withColumnRenamed("token", "symbol"), "symbol_places")
    at = ["commit_sha", "path", "line_no"]
    return symbols.join(hits.join(lines.select(*at, "text").join(few(hits.select(*at).distinct()), at, "left_semi"), at), ["commit_sha", "symbol"])


def under(path: Column, prefix: Column) -> Column:
    """Is path the prefix itself, or below it? The empty prefix holds all."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


#: Characters of a gram; each place of a line begins one, as a line's end is padded.
GRAM = 3


def gram_index(lines: DataFrame) -> DataFrame:
    """(commit_sha, gram, path, line_no, at) for lines (commit_sha, path, line_no, text): the gram of three characters at each place of a line.

    Write it bucketed by commit and gram to search it often.
    """
    padded = F.concat("text", F.lit("\0" * (GRAM - 1)))
    grams = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return lines.where("text <> ''").select("commit_sha", "path", "line_no", F.posexplode(grams).alias("at", "gram"))


#: Queries of a commit that are compared with each of its lines; where a commit has more, grams are cheaper.
COMPARED = 1_000


def literal_places(asked: DataFrame, lines: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(commit_sha, query, path, line_no, text): all lines that hold a query; asked: distinct (commit_sha, query), none empty.

    Up to ``COMPARED`` queries a commit are compared with its lines as these are read, without a shuffle. More of them meet grams: a query only the places of its
    rarest gram, of these only the ones where its second rarest stands as far off as in the query, and only those lines are compared with their text. A query
    shorter than a gram meets the places that begin with it.
    """
    if index is None:
        most = asked.groupBy("commit_sha").count().agg(F.max("count"), F.sum("count")).first()
        if (most[0] or 0) <= COMPARED and (most[1] or 0) <= ordered.FEW:
            q = F.broadcast(asked.withColumnRenamed("commit_sha", "_commit"))
            return lines.join(q, (F.col("commit_sha") == F.col("_commit")) & F.contains("text", "query")).select("commit_sha", "query", "path", "line_no", "text")
    index = gram_index(lines) if index is None else index
    n = F.length("query")
    own = F.regexp_extract_all("query", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    wanted = asked.where(n >= GRAM).select("commit_sha", "query", F.posexplode(own).alias("at", "gram"))
    # one pass over the index leaves the grams that some query has
    places = stored(index.join(few(wanted.select("commit_sha", "gram").distinct()), ["commit_sha", "gram"], "left_semi").select("commit_sha", "gram", "path", "line_no", "at"), "gram_places")
    sizes = places.groupBy("commit_sha", "gram").agg(F.count("*").alias("n"))
    # a gram that the commit lacks has no places, and is the rarest
    ranked = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram"))), 1, 2)
    two = wanted.join(sizes, ["commit_sha", "gram"], "left").groupBy("commit_sha", "query").agg(ranked.alias("g"))
    first, second = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    rare = two.select("commit_sha", "query", first["gram"].alias("gram"), second["gram"].alias("gram2"), (second["at"] - first["at"]).alias("away"))
    begun = rare.join(places, ["commit_sha", "gram"]).withColumn("at", F.col("at") + F.coalesce("away", F.lit(0))).drop("gram")
    met = begun.where("gram2 is not null").withColumnRenamed("gram2", "gram").join(places, ["commit_sha", "gram", "path", "line_no", "at"])
    short = asked.where(n < GRAM)
    begins = F.explode(F.array(*[F.left("gram", F.lit(k)) for k in range(1, GRAM)])).alias("query")
    begin = index.select("commit_sha", "path", "line_no", begins).join(short, ["commit_sha", "query"])
    found = [df.select("commit_sha", "query", "path", "line_no") for df in (begun.where("gram2 is null"), met, begin)]
    at = found[0].unionByName(found[1]).unionByName(found[2]).distinct()
    held = at.join(lines.select("commit_sha", "path", "line_no", "text"), ["commit_sha", "path", "line_no"]).where(F.contains("text", "query"))
    return held.select("commit_sha", "query", "path", "line_no", "text")


def literal_hits(requests: DataFrame, lines: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(request_id, path, line_no, text): all lines that hold a request's query (request_id, commit_sha, prefix, query), under its prefix. Queries that repeat are searched for once."""
    held = literal_places(requests.where("query <> ''").select("commit_sha", "query").distinct(), lines, index)
    return requests.select("request_id", "commit_sha", "prefix", "query").join(held, ["commit_sha", "query"]).where(under(F.col("path"), F.col("prefix"))).select("request_id", "path", "line_no", "text")


def literal_search(requests: DataFrame, lines: DataFrame, page: int = 12, max_offset: int = 100_000, index: DataFrame | None = None) -> DataFrame:
    """Hits of each request (request_id, commit_sha, prefix, query, start), paged by offset, found by ``literal_places``.

    start counts hits from 1; null is 1. Columns hit_no and more. Places are put in order once for all requests with one query and prefix, up to the last
    page that any request wants; only lines on a page come with their text.
    """
    r = requests.select("request_id", "commit_sha", "prefix", "query", F.coalesce("start", F.lit(1)).alias("start")).where((F.col("start") <= max_offset) & (F.col("query") != ""))
    search, at = ["commit_sha", "query", "prefix"], ["commit_sha", "path", "line_no"]
    last = (r.agg(F.max("start")).first()[0] or 1) + page
    held = literal_places(r.select("commit_sha", "query").distinct(), lines, index).drop("text")
    hit = held.join(few(r.select(*search).distinct()), ["commit_sha", "query"]).where(under(F.col("path"), F.col("prefix")))
    place = F.row_number().over(Window.partitionBy(*search).orderBy("path", "line_no"))
    hit = hit.withColumn("hit_no", place).where(F.col("hit_no") <= last).join(r, search).where(F.col("hit_no").between(F.col("start"), F.col("start") + page))
    more = F.max("hit_no").over(Window.partitionBy("request_id")) >= F.col("start") + page
    hit = stored(hit.withColumn("more", more).where(F.col("hit_no") < F.col("start") + page).select("request_id", *at, "hit_no", "more"), "hits")
    texts = lines.select(*at, "text").join(few(hit.select(*at).distinct()), at, "left_semi").dropDuplicates(at)
    return hit.join(texts, at).select("request_id", "path", "line_no", "text", "hit_no", "more")


def line_range_read(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each request (request_id, commit_sha, path, start, end): a range join, local to the file; the end is clamped by it."""
    return lines.join(few(requests), ["commit_sha", "path"]).where(F.col("line_no").between(F.col("start"), F.col("end"))).select("request_id", "path", "line_no", "text")


#: Paths of a block of the path table; a page is smaller.
BLOCK = 128


def path_table(tree: DataFrame) -> DataFrame:
    """(commit_sha, path, block) of a tree's paths, once each: a block is 128 that follow one another. Write it to list from it often."""
    rows = tree.select("commit_sha", "path").distinct().withColumn("one", F.lit(1))
    return running(rows, ["commit_sha", "path"], {"nth": "one"}, "path_table").select("commit_sha", "path", F.floor((F.col("nth") - 1) / BLOCK).alias("block"))


def path_list(requests: DataFrame, tree: DataFrame, page: int = 100, paths: DataFrame | None = None) -> DataFrame:
    """Paths of each request (request_id, commit_sha, prefix, cursor) after its cursor: (request_id, path, place, more, next_cursor).

    Below a prefix the paths are one interval of the ordered table. Where it begins is found among the first paths of all blocks,
    in one pass over these and the requests; then a page meets the two blocks that hold it. The prefix as a path of its own
    is looked up.
    """
    if page >= BLOCK:
        raise ValueError(f"a page has less than {BLOCK} paths")
    paths = stored(path_table(tree), "paths") if paths is None else paths
    r = requests.select("request_id", "commit_sha", "prefix", F.coalesce("cursor", F.lit("")).alias("cursor"))
    below = F.when(F.col("prefix") == "", "").otherwise(F.concat("prefix", F.lit("/")))
    r = r.withColumn("from", F.greatest(below, F.col("cursor")))
    fences = paths.groupBy("block").agg(F.min(F.struct("commit_sha", "path")).alias("f")).select("f.commit_sha", F.col("f.path").alias("from"), F.lit(None).cast(r.schema["request_id"].dataType).alias("request_id"), F.lit(1).alias("fence"))
    marked = fences.unionByName(r.select("commit_sha", "from", "request_id", F.lit(0).alias("fence"))).withColumn("after", 1 - F.col("fence"))
    begins = running(marked, ["commit_sha", "from", "after"], {"fences": "fence"}, "path_fences").where("fence = 0")
    # what comes from there on begins in the block of the last fence that is not behind, or with the next one
    blocks = begins.select("request_id", F.explode(F.array(F.col("fences") - 1, F.col("fences"))).alias("block"))
    inside = paths.join(blocks, "block").join(r, ["request_id", "commit_sha"]).where((F.col("path") > F.col("cursor")) & ((F.col("prefix") == "") | F.startswith(F.col("path"), below)))
    same = paths.join(r.where("prefix <> '' and prefix > cursor"), (paths.commit_sha == r.commit_sha) & (paths.path == r.prefix)).select("request_id", "path")
    hit = inside.select("request_id", "path").unionByName(same).withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("path"))).where(F.col("place") <= page + 1)
    whole = Window.partitionBy("request_id")
    more = F.max("place").over(whole) > page
    hit = hit.withColumn("more", more).where(F.col("place") <= page)
    return hit.select("request_id", "path", "place", "more", F.when(F.col("more"), F.max("path").over(whole)).alias("next_cursor"))


def validate_requests(requests: DataFrame, cap: int = 8, read_lines: int = 400, max_offset: int = 100_000, max_query: int = 500) -> DataFrame:
    """requests (review_id, batch_id, round, seq, action, path, query, start_line, end_line) with error; those beyond the cap are errors too.

    Paths, and the cursors of lists, come out in their normal form, which the other operators want.
    """
    path = action_path(F.coalesce("path", F.lit("")))
    start, end, query = F.col("start_line"), F.col("end_line"), F.coalesce("query", F.lit(""))
    cursor = F.when(query == "", "").otherwise(action_path(query))
    rank = F.row_number().over(Window.partitionBy("review_id", "batch_id", "round").orderBy("seq"))
    read = path.isNull() | (path == "") | (query != "") | start.isNull() | (start < 1) | end.isNull() | (end < start) | (end - start + 1 > read_lines)
    search = path.isNull() | (query == "") | (F.length(query) > max_query) | query.rlike(r"[\x00\r\n]") | (start < 1) | (start > max_offset) | end.isNotNull()
    listing = path.isNull() | cursor.isNull() | ((query != "") & (cursor == "")) | start.isNotNull() | end.isNotNull()
    error = (
        F.when(rank > cap, "too many requests").when(~F.coalesce(F.col("action").isin("read", "search", "list"), F.lit(False)), "action type is unsupported")
        .when((F.col("action") == "read") & F.coalesce(read, F.lit(True)), "read action has invalid arguments")
        .when((F.col("action") == "search") & F.coalesce(search, F.lit(False)), "search action has invalid arguments")
        .when((F.col("action") == "list") & F.coalesce(listing, F.lit(False)), "list action has invalid arguments")
    )
    rows = requests.withColumn("error", error)
    sound = F.col("error").isNull()
    return rows.withColumns({"path": F.when(sound, path).otherwise(F.col("path")), "query": F.when(sound & (F.col("action") == "list"), cursor).otherwise(query)})


def dedup_requests(requests: DataFrame) -> DataFrame:
    """requests with is_first: the first of each key; a search from null and from 1 are one."""
    start = F.when(F.col("action") == "search", F.coalesce("start_line", F.lit(1))).otherwise(F.col("start_line"))
    key = [F.col("review_id"), F.col("batch_id"), F.col("action"), F.col("path"), F.col("query"), start, F.col("end_line")]
    return requests.withColumn("is_first", F.row_number().over(Window.partitionBy(*key).orderBy("round", "seq")) == 1)


def legal_cursors(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """requests (review_id, batch_id, action, path, query, cursor, round) with legal: a null cursor is a first page, others must be the one offered last before their round.

    offers: (review_id, batch_id, action, path, query, cursor, round), by round; a null cursor says that there is no more. After an offer, the
    first page isn't the next one either. ``replay`` makes the offers as it goes.
    """
    key = ["review_id", "batch_id", "action", "path", "query"]
    both = requests.withColumns({"_asks": F.lit(True), "_offer": F.lit(None).cast("string")}).unionByName(
        offers.select(*key, "round", F.struct(F.col("cursor")).alias("_o")).groupBy(*key, "round").agg(F.max("_o.cursor").alias("_offer")).withColumn("_asks", F.lit(False)), allowMissingColumns=True
    )
    earlier = Window.partitionBy(*key).orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("_last", F.last(F.when(~F.col("_asks"), F.struct("_offer")), ignorenulls=True).over(earlier)).where("_asks")
    expected = F.when(F.col("_last").isNull(), F.lit(None).cast("string")).otherwise(F.col("_last._offer"))
    legal = F.when(F.col("_last").isNotNull() & expected.isNull(), False).otherwise(expected.eqNullSafe(F.col("cursor")))
    return rows.withColumn("legal", legal).select(*requests.columns, "legal")


# What a source file that may have tests ends with.
SOURCE_SUFFIXES = (".c", ".cc", ".cpp", ".cs", ".go", ".java", ".js", ".jsx", ".kt", ".php", ".py", ".rb", ".rs", ".scala", ".swift", ".ts", ".tsx")


def related_tests(paths: DataFrame, tree: DataFrame, limit: int = 10, suffixes: tuple[str, ...] = SOURCE_SUFFIXES) -> DataFrame:
    """(review_id, path, test_path, rank): tests whose stem holds the path's stem, or shares a word of three letters or more with it.

    Words meet in an equi join, each with its first tests alone, which is exact as only the first of all are returned. A stem inside
    another is found by its rarest gram of three characters, counted over the tests of its commit, and then compared; a stem
    shorter than that by the grams that begin with it.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda w: F.length(w) >= 3)
    tests = tree.where(is_test_path(F.col("path"))).select("commit_sha", F.col("path").alias("test_path")).distinct()
    if suffixes:
        tests = tests.where(F.lower(F.concat(F.lit("."), F.element_at(F.split("test_path", r"\."), -1))).isin(*suffixes))
    tests = tests.withColumn("test_stem", F.lower(stem(F.col("test_path"))))
    want = paths.select("review_id", "commit_sha", "path").withColumn("own_stem", F.lower(stem(F.col("path"))))
    nth = F.row_number().over(Window.partitionBy("commit_sha", "w").orderBy("test_path"))
    postings = tests.select("*", F.explode(words(F.col("test_stem"))).alias("w")).withColumn("_n", nth).where(F.col("_n") <= limit + 1)
    by_word = want.select("*", F.explode(words(stem(F.col("path")))).alias("w")).join(postings, ["commit_sha", "w"])
    stems = tests.select("commit_sha", "test_path", F.lit(1).alias("line_no"), F.col("test_stem").alias("text")).withColumnRenamed("test_path", "path")
    asked = want.where("own_stem <> ''").select("commit_sha", "own_stem").distinct()
    asked = asked.select(F.struct("commit_sha", "own_stem").alias("request_id"), "commit_sha", F.lit("").alias("prefix"), F.col("own_stem").alias("query"))
    inside = literal_hits(asked, stems).select("request_id.*", F.col("path").alias("test_path"))
    first = F.row_number().over(Window.partitionBy("commit_sha", "own_stem").orderBy("test_path"))
    by_stem = want.join(inside.withColumn("_n", first).where(F.col("_n") <= limit + 1), ["commit_sha", "own_stem"])
    cols = ["review_id", "path", "test_path"]
    both = by_word.select(*cols).unionByName(by_stem.select(*cols)).where("path <> test_path").distinct()
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("review_id", "path").orderBy("test_path"))).where(F.col("rank") <= limit)


# Fixed value: what stands for the paths that an index leaves out.
INDEX_MARKER = "...[repository index truncated; use list to inspect a prefix]"


def index_prefix(tree: DataFrame, limit: int) -> DataFrame:
    """(commit_sha, index, truncated): paths of each commit in order, with LF between; where not all fit in limit, as many as leave room for a marker, and the marker.

    Lengths are summed in global order, so no task reads a commit whole; only the paths that are shown meet.
    """
    if limit < len(INDEX_MARKER):
        raise ValueError(f"an index has {len(INDEX_MARKER)} characters at least")
    rows = tree.select("commit_sha", "path").distinct().withColumn("n", F.length("path").cast("long") + 1)
    summed = running(rows, ["commit_sha", "path"], {"upto": "n"}, "index_lengths")
    commits = summed.groupBy("commit_sha").agg((F.max("upto") - F.min(F.col("upto") - F.col("n")) - 1).alias("all"), F.min(F.col("upto") - F.col("n")).alias("before"))
    used = F.col("upto") - F.col("before") - 1
    shown = summed.join(commits, "commit_sha").where((F.col("all") <= limit) | (used + len(INDEX_MARKER) <= limit)).groupBy("commit_sha").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("paths"))
    out = commits.join(shown, "commit_sha", "left").withColumn("truncated", F.col("all") > limit).withColumn("paths", F.coalesce("paths", F.lit("")))
    cut = F.concat("paths", F.when(F.col("paths") != "", "\n").otherwise(""), F.lit(INDEX_MARKER))
    return out.select("commit_sha", F.when(F.col("truncated"), F.left(cut, F.lit(limit))).otherwise(F.col("paths")).alias("index"), "truncated")
