"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes that Spark counts.

Every window of ``WINDOW`` consecutive words has two rolling hashes over the
words' hashes, 128 bits together.  A document loses every word under a window
that starts in a document of a smaller id too; windows that overlap or touch
merge into maximal removal intervals.  Windows are judged on the input, so the
first document of a passage keeps it whole.

Few windows repeat, and Spark need not see the others:

1. documents of equal text form a class, which has all windows of its smallest
   id; every other row of the class loses all words;
2. a window's anchor is the least of the rolling hashes of its ``GRAIN``-word
   parts.  Equal windows have equal anchors, and a text has about one anchor in
   twenty words.  Spark counts anchors over classes; a window whose anchor stands
   in one class only can't repeat;
3. the other windows, as rows of their hashes, are grouped for the smallest id
   and joined back; a class gathers its own repeated windows only.

No step brings the documents of a passage together: groups are summed up where
they are read, and joins are between a table and its own summary, which Spark
can split where one key is hot.

Defined cases: a null or empty text has no words and loses nothing; a text of
fewer words than a window loses nothing; a very long text is handled alone, in
arrays of a few dozen bytes a word; ids are of any type with an order, and rows
that share an id (null ids are one such, the largest) don't remove words from
each other; every row gives one result; an empty table gives an empty one; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import split_words
from .common import apart, field, slices, splitmix, text_keys, written

WINDOW, GRAIN = 50, 8
#: Fixed odd bases of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NOTHING = hashlib.sha256(b"").hexdigest()
INTERVALS = "array<struct<start:int,end:int>>"


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, in room that doubles."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The rolling hash of every window in an array of word hashes.

    With S the running sum of word x base^position, a window's hash is the
    difference of two sums, divided by the power of its start.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
    return splitmix((sums[window:] - sums[:-window]) * powers(pow(base, -1, 1 << 64), n))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x, done = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0], done + step
    return x


class SliceWindows:
    """Words and windows of a slice of documents, end to end."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = [split_words(t, lower=False) for t in texts]
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for ws in self.words for w in ws], np.int64)
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in number]), ">u8").reshape(-1, 2).astype(np.uint64)
        self.hashes = [digests[:, k][ids] for k in (0, 1)]
        self.window = window
        sizes = np.array([len(ws) for ws in self.words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        n = np.maximum(0, sizes - window + 1)
        #: Of every window that lies in one document: its document and its start there.
        self.doc = np.repeat(np.arange(len(sizes)), n)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.start + starts[self.doc]
        #: Where each document's windows begin, and the end.
        self.cuts = np.concatenate([[0], np.cumsum(n)])

    def window_hashes(self, k: int) -> np.ndarray:
        return window_hashes(self.hashes[k], self.window, BASES[k])[self.at]

    def anchors(self) -> np.ndarray:
        grain = min(GRAIN, self.window)
        return sliding_least(window_hashes(self.hashes[0], grain, BASES[0]), self.window - grain + 1)[self.at]


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _described(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """k1, k2, id, n_words, digest (of all words), kept, anchors of every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                w = SliceWindows(part.column(3).to_pylist(), window)
                joined = [b" ".join(ws) for ws in w.words]
                a = w.anchors()
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (w.doc[1:] != w.doc[:-1])]) if len(a) else np.zeros(0, bool)
                cuts = np.concatenate([[0], np.cumsum(new)])[w.cuts]
                columns = [
                    *part.columns[:3],
                    pa.array([len(ws) for ws in w.words], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()),
                    pa.array([x.decode("utf-8", "surrogatepass") if keep_text else None for x in joined], pa.string()),
                    _lists(a[new].view(np.int64), cuts, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "id", "n_words", "digest", "kept", "anchors"])

    return docs.mapInArrow(run, f"k1 long, k2 long, {field(docs, 'id')}, n_words long, digest string, kept string, anchors array<long>")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """h1, h2, c, id, start of the windows whose anchor is in ``anchors``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                w = SliceWindows(part.column(2).to_pylist(), window)
                a = w.anchors().view(np.int64)
                shared = [np.isin(a[lo:hi], wanted) for lo, hi, wanted in zip(w.cuts, w.cuts[1:], part.column(3).to_pylist())]
                found = np.flatnonzero(np.concatenate(shared)) if shared else np.zeros(0, np.int64)
                owner = pa.array(w.doc[found])
                hashes = [pa.array(w.window_hashes(k)[found].view(np.int64)) for k in (0, 1)]
                columns = [*hashes, *(part.column(k).take(owner) for k in range(2)), pa.array(w.start[found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "c", "id", "start"])

    return texts.mapInArrow(run, f"h1 long, h2 long, c long, {field(texts, 'id')}, start int")


def _cut(texts: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """k1, k2, and cut: what is left of a text without the windows at ``starts``."""

    def one(text: str, starts: list[int]) -> dict:
        words = split_words(text, lower=False)
        steps = np.zeros(len(words) + 1, np.int64)
        at = np.array(starts, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
        gone = np.cumsum(steps[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
        kept = b" ".join([x for x, g in zip(words, gone.tolist()) if not g])
        return {"n_removed": int(gone.sum()), "intervals": [{"start": a, "end": b} for a, b in edges], "digest": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "surrogatepass") if keep_text else None}

    kind = pa.struct([("n_removed", pa.int64()), ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("digest", pa.string()), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                cuts = [one(t, s) for t, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(cuts, kind)], names=["k1", "k2", "cut"])

    return texts.mapInArrow(run, f"k1 long, k2 long, cut struct<n_removed:long,intervals:{INTERVALS},digest:string,kept:string>")


def _smaller(least: Column, own: Column) -> Column:
    """Null ids are the largest."""
    return least.isNotNull() & (own.isNull() | (least < own))


def substring_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, intervals (of removed words, end exclusive),
    kept_sha256, and kept: the words that stay, joined by single spaces (null
    unless ``keep_text``).
    """
    key = ["k1", "k2"]
    docs = df.select(*text_keys(F.col(text_col)), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(_described(docs, window, keep_text))
    # classes have short numbers, which the rows of their windows carry
    classes = written(rows.groupBy(*key).agg(F.min("id").alias("id"), F.first("anchors").alias("anchors")).withColumn("c", F.monotonically_increasing_id()))
    own = classes.drop("anchors")

    # anchors of several classes
    held = classes.select("c", F.explode("anchors").alias("anchor"))
    repeated = held.groupBy("anchor").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("anchor")
    wanted = held.join(apart(repeated, "anchor"), "anchor").groupBy("c").agg(F.collect_set("anchor").alias("anchors")).join(own, "c")

    texts = docs.groupBy(*key).agg(F.first("text").alias("text"))
    windows = _windows(texts.join(wanted, key).select("c", "id", "text", "anchors"), window)
    ids = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("id").alias("with_id"), F.count(F.lit(1)).alias("n"))
    first = ids.filter((F.col("least") < F.col("most")) | F.col("with_id").between(1, F.col("n") - 1)).select("h1", "h2", "least")
    hits = windows.join(apart(first, "h1", "h2"), ["h1", "h2"]).filter(_smaller(F.col("least"), F.col("id"))).groupBy("c").agg(F.collect_set("start").alias("starts")).join(own, "c")
    cuts = _cut(texts.join(hits, key).select(*key, "text", "starts"), window, keep_text)
    facts = written(own.select(*key, F.col("id").alias("least")).join(cuts, key, "left"))

    joined = rows.join(facts, key)
    copy = _smaller(F.col("least"), F.col("id")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    pick = lambda all_gone, name, untouched: F.when(copy, all_gone).when(F.col("cut").isNotNull(), F.col(f"cut.{name}")).otherwise(untouched)
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        pick(F.col("n_words"), "n_removed", F.lit(0).cast("long")).alias("n_removed"),
        pick(whole, "intervals", F.array().cast(INTERVALS)).alias("intervals"),
        pick(F.lit(NOTHING), "digest", F.col("digest")).alias("kept_sha256"),
        pick(F.lit("" if keep_text else None).cast("string"), "kept", F.col("kept")).alias("kept"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
