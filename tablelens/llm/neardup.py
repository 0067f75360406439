"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class, its smallest id stands for it.
Signatures of ``PERMUTATIONS`` min-hashes are cut into bands; classes that
share a band are candidates.  A candidate pair is compared batch by batch: once
the posterior probability of a similarity at or over the threshold falls under
``MISS`` the pair is pruned; survivors are verified on their full shingle sets.

Components need few of a bucket's pairs, so candidates come in two rounds:

1. every member of a bucket with the bucket's pivot, the member that shares the
   most buckets, so likely the centre of its copies;
2. where a bucket still holds several components, the pairs between them that
   their overlap with the pivot doesn't rule out (see ``_across_components``).

So no candidate between different components goes unseen, and a group of n near
copies costs about n pairs, not n^2.  Links meet in connected components by
alternating large-star and small-star steps.

Defined cases: a null text or one without words has an empty set, n_shingles 0,
and stays alone; a text of fewer words than a shingle has one shingle, all its
words; a very long text is hashed alone, in a few dozen bytes a word; ids are
integers (others are an error).  ``near_duplicates`` tells documents apart by id:
rows with equal ids are one document, each row gives a result, and a null id gives
a null component and is kept.  ``drop_near_duplicates`` judges rows: repeated and
null ids are no exception, and of rows with equal ids the first one stays.  An empty
table gives an empty one; other columns, whatever their names, pass through or are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import split_words
from .common import apart, checkpointed, free_name, map_texts, splitmix, written

PERMUTATIONS, BAND_ROWS = 128, 4
#: Similar means intersection >= THRESHOLD * union.
THRESHOLD = 0.8
SHINGLE = 5
#: Signature entries compared at a time, and the chance of pruning a similar pair.
BATCH, MISS = 16, 1e-7


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = split_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))[ids]
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


_SEEDS = splitmix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_MULTIPLY, _ADD = _SEEDS[:PERMUTATIONS, None] | np.uint64(1), _SEEDS[PERMUTATIONS:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set, as 32 bits."""
    least = None
    for at in range(0, len(hashes), 1024):
        part = (hashes[None, at : at + 1024] * _MULTIPLY + _ADD).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = PERMUTATIONS) -> list[int]:
    """For each batch's end: fewer matching entries than this prune a pair.

    Under a uniform prior the similarity given m of n matches is Beta(m + 1,
    n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, term, m = 0.0, (1 - threshold) ** (n + 1), 0
        while tail + term < miss:
            tail += term
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return out


def _signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, fp (a digest of the set), sig."""

    def make():
        def rows(ids, texts):
            out = []
            for i, t in zip(ids, texts):
                s = shingle_hashes(t, n)
                out.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (i, 0, None, None))
            return out

        return rows

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, n_shingles long, fp binary, sig binary", "id", "text")


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) that the sequential test doesn't prune."""
    from pyspark.sql import types as T

    limits = least_matches(threshold)
    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for k in (2, 3))
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for k, limit in enumerate(limits):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[matches[alive] >= limit]
            yield batch.select([0, 1]).take(pa.array(alive))

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """a, b, common, total: exact sizes of intersection and union of every pair."""
    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        import pyarrow as pa

        last: dict[int, tuple] = {}

        def hashes(side: int, text: str) -> np.ndarray:
            if last.get(side, (None,))[0] != text:
                last[side] = text, shingle_hashes(text, n)
            return last[side][1]

        for batch in batches:
            common, total = [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = hashes(0, ta), hashes(1, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long, common long, total long")


def _against_pivot(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pivot, id, comp, n (size of the member's set), k (what it shares with the
    pivot's), extra (its other shingles)."""
    own, other = texts.select("id", F.col("text").alias("t")), texts.select(F.col("id").alias("pivot"), F.col("text").alias("p"))

    def run(batches):
        import pyarrow as pa

        last = None, None
        for batch in batches:
            sizes, shared, extra = [], [], []
            for t, p in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if last[0] != p:
                    last = p, shingle_hashes(p, n)
                x = shingle_hashes(t, n)
                rest = np.setdiff1d(x, last[1], assume_unique=True)
                sizes.append(len(x))
                shared.append(len(x) - len(rest))
                extra.append(rest.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(shared, pa.int32()), pa.array(extra, pa.list_(pa.int64()))], names=["pivot", "id", "comp", "n", "k", "extra"])

    joined = members.join(own, "id").join(other, "pivot").select("pivot", "id", "comp", "t", "p")
    return joined.mapInArrow(run, "pivot long, id long, comp long, n int, k int, extra array<long>")


def _across_components(members: DataFrame, percent: float) -> DataFrame:
    """Pairs (a, b), a < b, between components of one pivot that can be similar.

    Sets s and x need o = percent (|s| + |x|) / (100 + percent) shingles in
    common.  Of those at most min(k_s, k_x) are the pivot's; the others are
    extra to both.  So either the pivot's alone may do, which their sizes say, or
    the two share an extra shingle: in the order of these (those that only one
    component has first, then rarest first) the first one they share leaves at
    most as many more as follow it in either set.
    """
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100.0 + percent) - 1e-9) - F.least("x.k", "y.k")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n") - 1e-6
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]

    # the pivot's shingles may do: kinds of members first, then their members
    # need <= 0 takes this share of either set at least, and like sizes are in the
    # same or in neighbouring bands of sizes
    band = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).cast("int")
    kinds = members.filter(F.col("k") * 100 >= F.col("n") * percent - 1e-6).select("pivot", "comp", "n", "k").distinct().withColumn("band", band)
    near = kinds.withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
    close = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") < F.col("y.comp")) & sizes & (need <= 0)
    both = near.alias("x").join(kinds.alias("y"), close).select(F.col("x.pivot").alias("pivot"), *(F.col(f"{side}.{c}").alias(f"{side}{c}") for side in "xy" for c in ("comp", "n", "k")))
    of = lambda side: members.select("pivot", F.struct("id").alias(side), *(F.col(c).alias(f"{side}{c}") for c in ("comp", "n", "k")))
    by_pivot = both.join(of("x"), ["pivot", "xcomp", "xn", "xk"]).join(of("y"), ["pivot", "ycomp", "yn", "yk"]).select(*pair)

    # they share an extra shingle
    held = members.select("pivot", "id", "comp", "n", "k", F.explode("extra").alias("token"))
    counts = held.groupBy("pivot", "token", "comp").agg(F.count("*").alias("c"))
    useful = counts.groupBy("pivot", "token").agg(F.sum("c").alias("df"), F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("top")).filter("comps > 1")
    own = Window.partitionBy("pivot", "id")
    placed = held.join(useful, ["pivot", "token"]).withColumn("after", F.count("*").over(own) - F.row_number().over(own.orderBy("df", "token")))
    minor = placed.filter("comp <> top").alias("x")
    again = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
    once = (F.col("y.comp") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    by_extra = minor.join(placed.alias("y"), again & once & sizes & (1 + F.least("x.after", "y.after") >= need)).select(*pair)
    return by_pivot.union(by_extra).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, comp (least id of its component) of every id in ``edges`` (a, b).

    Alternating large-star and small-star; each step is a join and an
    aggregation, its result a checkpoint.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(edges.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class_id (least id with an equal set), component_id, kept."""
    percent = round(100 * threshold, 6)
    sigs = checkpointed(_signatures(docs, shingle, id_col, text_col))
    known = sigs.filter("fp IS NOT NULL AND id IS NOT NULL")
    classes = known.groupBy("fp").agg(F.min("id").alias("class_id"))
    heads = known.groupBy("fp").agg(F.min(F.struct("id", "sig")).alias("x")).select("x.*")

    # buckets with two members or more: h, id
    n_bands = PERMUTATIONS // BAND_ROWS
    band = F.expr(f"transform(sequence(0, {n_bands - 1}), k -> xxhash64(k, substring(sig, k * {4 * BAND_ROWS} + 1, {4 * BAND_ROWS})))")
    bands = heads.select("id", F.explode(band).alias("h"))
    full = bands.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    members = checkpointed(bands.join(apart(full, "h"), "h").select("h", "id", "n"))
    fame = members.groupBy("id").agg(F.sum("n").alias("fame"))
    chosen = checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(fame, "id").join(heads, "id").select("id", "fame", "sig", "text"))
    texts = chosen.select("id", "text")
    famed = members.join(chosen.select("id", "fame"), "id")
    pivots = famed.groupBy("h").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("pivot"))
    # written, so that a hot bucket's rows can be split in this join and are summed
    # up in part before any later one
    pivoted = checkpointed(members.join(apart(pivots, "h"), "h").select("h", "id", "pivot"))

    def judged(pairs: DataFrame) -> DataFrame:
        """Exact sizes of the pairs that pass the sequential test, checkpointed."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return checkpointed(_verified(_pruned(pairs, chosen, threshold), texts, shingle, threshold))

    linked = F.col("common") * 100 >= F.col("total") * percent - 1e-6
    # 1. members with their bucket's pivot
    first = judged(pivoted.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    links = first.filter(linked).select("a", "b")
    comps = connected_components(links)

    # 2. members of buckets that still hold several components, against their pivot
    labelled = pivoted.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    members = labelled.join(apart(several, "h"), "h").select("pivot", "id", "comp").distinct()
    rest = _across_components(checkpointed(_against_pivot(members, texts, shingle)), percent)
    last = judged(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    comps = connected_components(links.union(last.filter(linked).select("a", "b")))

    # what is known of a class, joined to its rows; rows without a set or an id stay out
    facts = checkpointed(classes.join(comps.select(F.col("id").alias("class_id"), "comp"), "class_id", "left").select("fp", "class_id", F.coalesce("comp", "class_id").alias("component_id")))
    alone = sigs.filter("fp IS NULL OR id IS NULL").select("id", "n_shingles", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    joined = known.join(facts, "fp").select("id", "n_shingles", "class_id", "component_id").union(alone)
    return joined.select(F.col("id").alias(id_col), "n_shingles", "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component, of the smallest id, null last;
    columns unchanged.

    Rows are numbered and written first, so that a number means the same row in
    every later read.
    """
    row = free_name(docs, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(rows, shingle, threshold, row, text_col).select(F.col(row).alias("row"), F.col("component_id").alias("comp"))
    order = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    groups = checkpointed(groups.join(rows.select(F.col(row).alias("row"), order.alias("order")), "row"))
    kept = groups.groupBy("comp").agg(F.min("order").alias("least")).select(F.col("least.row").alias("row"))
    lost = groups.select("row").join(kept, "row", "left_anti").toDF(row)
    return rows.join(lost, row, "left_anti").drop(row)


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=2).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * common >= 80 * (na.n + nb.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
