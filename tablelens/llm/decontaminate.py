"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``WINDOW`` words (the whole item, if it has
fewer).  A text holds a window if it holds all shingles of it in place, so the
necessary prefix of a window is a single shingle: the rarest, under a global
order by the number of documents that hold it, then by the benchmark's.

Documents are read twice, whatever the benchmark's size.  Shingles of the benchmark
set two flags each in an array of at most 2^``MOST_FLAGS`` flags, which a scan tests
(a wrong flag costs a look-up and no result).  The first scan counts in how many documents
those shingles stand; the second keeps positions that may hold a window's prefix,
each with the words around it.  These join the windows on the prefix, positional
and length bounds place the window, and the words themselves are compared.  Joins
carry no hints: Spark broadcasts a side under its own size limit and splits hot
keys beyond it.

Defined cases: null and empty texts or items have no words and hit nothing; a very
long text is one row of words; items of equal text all count; every row gives one
result row, repeated ones and null ids too; ids of items sort as strings; an empty
benchmark hits nothing, and empty documents give an empty table; other columns,
whatever their names, pass through or are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_TO_Z, free_name, written

WINDOW = 10
#: Words of a shingle; windows of fewer words use single words.
SHINGLE = 3
#: Flags for each shingle in the array that a scan tests, and the logarithm of its
#: largest size (16 MB).
FLAGS_EACH, MOST_FLAGS = 64, 24
#: What stands between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null.

    Splitting at single characters takes a seventh of the time that searching for
    words takes.
    """
    lowered = F.translate(text, A_TO_Z, A_TO_Z.lower())
    return F.coalesce(F.filter(F.split(lowered, BETWEEN), lambda w: w != ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id and the words of its windows, each once, with 128 bits that name them."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col).cast("string")).alias("item")).filter(F.size("item") > 0).distinct()
    starts = F.expr(f"sequence(0, greatest(size(item) - {window}, 0))")
    windows = items.select("item_id", "item", F.explode(starts).alias("at")).select("item_id", F.slice("item", F.col("at") + 1, window).alias("w")).distinct()
    return windows.select("item_id", "w", *(F.xxhash64(F.lit(k), "w").alias(f"w{k}") for k in (1, 2)))


def shingle_at(words: str, at: str) -> str:
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {k})" for k in range(SHINGLE)) + ")"


def window_shingles(windows: DataFrame) -> DataFrame:
    """w, w1 and w2 of every distinct window, and its shingles: off (from 0), h,
    length in characters."""
    starts = F.expr(f"sequence(0, if(size(w) >= {SHINGLE}, size(w) - {SHINGLE}, size(w) - 1))")
    each = windows.select("w1", "w2", "w").distinct().select("*", F.explode(starts).alias("off"))
    return each.select("*", F.expr(f"if(size(w) >= {SHINGLE}, {shingle_at('w', 'off')}, xxhash64(w[off]))").alias("h"), F.expr(f"char_length(array_join(slice(w, off + 1, {SHINGLE}), ' '))").alias("length"))


def flags_of(hashes: DataFrame, most: int) -> tuple[Column, int]:
    """An array of 2^log booleans, as a scalar subquery, true at the lowest and at the
    highest ``log`` bits of every ``h``; and log."""
    hashes = hashes.select("h").distinct()
    log = min(max(6, math.ceil(math.log2(max(1, hashes.count()) * FLAGS_EACH))), most)
    # flags are put together as words of 64, few enough for one task to line up
    at = hashes.select(F.explode(F.array(F.col("h").bitwiseAND((1 << log) - 1), F.shiftrightunsigned("h", 64 - log))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = hashes.sparkSession.range(0, 1 << (log - 6), 1, 1).select(F.col("id").alias("k"))
    lined = every.join(words, "k", "left").select(F.struct("k", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    longs = lined.agg(F.array_sort(F.collect_list("x")).alias("x"))
    return longs.select(F.expr("flatten(transform(x, w -> transform(sequence(0, 63), b -> getbit(w.bits, b) = 1)))").alias("flags")).scalar(), log


def positions(texts: DataFrame, hashes: DataFrame, short: bool, most: int, result: str) -> DataFrame:
    """``texts`` without words, with x: n_words, and ``found``: ``result`` for every
    position whose shingle may be in ``hashes``, and for every such word, if ``short``.

    ``result`` is SQL over v.ws (the words), p (a position from 0) and {h} (the hash).
    """
    flags, log = flags_of(hashes, most)
    kinds = [(SHINGLE, shingle_at("v.ws", "p"))] + [(1, "xxhash64(get(v.ws, p))")] * short
    test = f"get(v.flags, cast({{h}} & {(1 << log) - 1} as int)) AND get(v.flags, cast(shiftrightunsigned({{h}}, {64 - log}) as int))"
    places = "if(size(v.ws) >= {n}, sequence(0, size(v.ws) - {n}), array())"
    found = [f"transform(filter({places.format(n=n)}, p -> {test.format(h=h)}), p -> {result.format(h=h)})" for n, h in kinds]
    # words and flags are bound once, as one value that the text refers to; no row of
    # the plan carries the flags, as both projections become one
    bound = texts.select("*", flags.alias("__flags"))
    once = f"transform(array(struct(words AS ws, __flags AS flags)), v -> struct(size(v.ws) AS n_words, concat({', '.join(found)}) AS found))[0]"
    return bound.select(*(c for c in texts.columns if c != "words"), F.expr(once).alias("x"))


def find_benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_flags: int = MOST_FLAGS) -> DataFrame:
    """id, n_words, n_hit (words inside any occurrence of a window), items (ids
    with occurring windows, sorted as strings), spans (start, end; from 1)."""
    held = written(benchmark_windows(benchmark, item_id_col, item_text_col, window))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("same"), words_of(F.col(text_col).cast("string")).alias("words"))
    sizes = held.agg(F.count("*").alias("n"), F.min(F.size("w")).alias("least")).first()
    if not sizes.n:
        return texts.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("spans"))
    short = sizes.least < SHINGLE

    # the prefix of every window: its rarest shingle
    shingles = window_shingles(held)
    seen = positions(texts.select("words"), shingles, short, most_flags, "{h}").select(F.explode(F.array_distinct("x.found")).alias("h"))
    spread = seen.groupBy("h").agg(F.count("*").alias("docs"))
    common = shingles.groupBy("h").agg(F.count("*").alias("windows")).join(spread, "h", "left")
    order = F.struct(F.coalesce("docs", F.lit(0).cast("long")), "windows", -F.col("length"), "h", "off")
    prefixes = written(shingles.join(common, "h").groupBy("w1", "w2").agg(F.min_by(F.struct("w", "off", "h"), order).alias("x")).select("w1", "w2", "x.*"))

    # positions of prefixes, and a null one for every row, which counts the row; null
    # keys are spread
    first = f"greatest(p - {window - 2}, 1)"
    candidates = positions(texts, prefixes, short, most_flags, f"struct(p + 1 AS pos, {{h}} AS h, {first} AS first, slice(v.ws, {first}, {2 * window}) AS around)")
    rows = candidates.select("id", "same", "x.n_words", F.explode(F.concat(F.array(F.lit(None)), F.col("x.found"))).alias("c"))
    rows = rows.select("id", "same", "n_words", F.col("c").isNull().cast("long").alias("copy"), F.coalesce("c.h", F.xxhash64("id", "same", "n_words")).alias("h"), "c.pos", "c.first", "c.around")
    start = F.col("pos") - F.col("off")
    end = start + F.size("w") - 1
    placed = (start >= 1) & (end <= F.col("n_words")) & (F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("w")) == F.col("w"))
    side = prefixes.select(F.col("h").alias("ph"), "off", "w", "w1", "w2")
    span = F.when(F.col("w").isNotNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    hits = rows.join(side, (F.col("h") == F.col("ph")) & placed, "left").select("id", "same", "n_words", "copy", span.alias("span"), F.coalesce("w1", F.xxhash64("same", "id")).alias("k1"), F.col("w2").alias("k2"))

    # the items of the windows that occur
    owners = held.select(F.col("w1").alias("o1"), F.col("w2").alias("o2"), "item_id")
    named = hits.join(owners, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left")
    # a hit has a row for each item of its window, a row's count its own
    grouped = named.groupBy("id", "same", "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"), F.sum("copy").cast("int").alias("copies"))
    grouped = grouped.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("copies"))))
    covered = F.expr("aggregate(spans, struct(0L AS n, 0 AS last), (a, s) -> struct(a.n + greatest(0, s.end - greatest(a.last, s.start - 1)) AS n, greatest(a.last, s.end) AS last), a -> a.n)")
    return grouped.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no hit; columns unchanged, ids unread.

    Rows are matched by the SHA-256 digest of their text, which a hit always has.
    """
    digest, name = F.sha2(docs[text_col].cast("string").cast("binary"), 256), free_name(docs, "__hit")
    hit = find_benchmark_hits(docs.select(digest.alias("digest"), docs[text_col].alias("text")), benchmark, "digest", "text").filter(F.col("n_hit") > 0).select(F.col("digest").alias(name)).distinct()
    return docs.join(hit, digest == F.col(name), "left_anti")


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_benchmark_hits(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, s, pos.m AS m FROM pos JOIN win ON pos.k = win.k AND pos.m = win.m),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
