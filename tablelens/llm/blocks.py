"""Corpus-wide tables of hashes, kept beside the documents that hold them.

Documents are dealt to blocks by a hash of their id and text, so that no id (null
is one) gathers rows in a block; only rows equal in both share one.  A block sums up
its own hashes first and sends each distinct one once, to the bucket of the hash; a
bucket merges the entries of all blocks and answers each block with what it can't
know itself, naming an entry by its place in what the block sent, not by its hash.
So a hash that a third of all documents hold costs a bucket one entry a block, the
corpus is never in one place, and a task holds one block or one bucket.

Entries for the same bucket travel in one row, as sorted 64-bit hashes,
difference-coded by byte planes, which halves the shuffle.  Blocks and buckets have
a size, so their numbers grow with the corpus; only buckets that a block has
entries for get a row, so rows are at most blocks x buckets and at most the
entries.  From about a terabyte on a row holds few entries, and the exchange costs
what one plain row for each entry would.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII

PACKED = "bucket int, block int, n int, hashes binary, counts binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


#: Fewer values than this are not worth compressing.
FEW = 32


def pack64(x: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed; few ones as they are."""
    x = np.ascontiguousarray(x.astype("<u8", copy=False))
    if len(x) < FEW:
        return x.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack64(data: bytes, n: int) -> np.ndarray:
    if n < FEW:
        return np.frombuffer(data, "<u8")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack64(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack64(data, n), dtype=np.uint64)


def with_block(df: DataFrame, n_blocks: int, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """block, id, text and ``more`` of every row, dealt by id and text."""
    return df.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *more,
    )


class BlockWords:
    """The words of a block's texts as local numbers, and a 64-bit hash of each word."""

    def __init__(self, texts: Iterable[str | None], lower: bool):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts, sizes = [], []
        for text in texts:
            words = split_words(text, lower)
            parts.append(np.array([number[w] for w in words], np.int32))
            sizes.append(len(words))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Words of a text in UTF-8, parted by ASCII white space; ``lower``: A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER_ASCII) if lower else raw).split()


def buckets_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of every hash; sorted hashes have sorted buckets."""
    return (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, np.int64)


def packed_rows(buckets: np.ndarray, blocks: np.ndarray, keys: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> pa.Table:
    """A row for each run between ``cuts``: ``keys`` ascend within it."""
    spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
    columns = [buckets[cuts[:-1]], blocks[cuts[:-1]], np.diff(cuts), [pack_sorted(keys[a:b]) for a, b in spans], [pack64(values[a:b]) for a, b in spans]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED_ARROW)], schema=PACKED_ARROW)


def to_buckets(block: int, hashes: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.Table:
    """Entries with distinct, sorted hashes, a packed row for each bucket that has some."""
    buckets = buckets_of(hashes, n_buckets).astype(np.int32)
    return packed_rows(buckets, np.full(len(hashes), block, np.int32), hashes, counts, runs_of(buckets))


def collected(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, count, block and place in the block's row of all entries, by hash."""
    sizes = table["n"].to_pylist()
    if not sizes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.concatenate([unpack_sorted(x, n) for x, n in zip(table["hashes"].to_pylist(), sizes)])
    c = np.concatenate([unpack64(x, n) for x, n in zip(table["counts"].to_pylist(), sizes)]).view(np.int64)
    b = np.repeat(np.array(table["block"].to_pylist(), np.int32), sizes)
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    order = np.argsort(h, kind="stable")
    return h[order], c[order], b[order], place[order]


def block_entries(blocks: DataFrame, entries: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n_buckets: int) -> DataFrame:
    """Packed rows: ``entries`` sums up a block's documents as sorted hashes and counts."""

    def run(key, docs):
        return to_buckets(key[0].as_py(), *entries(docs), n_buckets)

    return blocks.groupBy("block").applyInArrow(run, PACKED)


def merged_answers(packed: DataFrame, merge: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Answers to the blocks, packed: ``hashes`` holds places in the block's row.

    ``merge`` gets a bucket's counts, the start of each hash's run, and the run
    of each entry; it returns which entries to answer, and the answers.
    """

    def run(key, table):
        h, c, b, place = collected(table)
        starts = runs_of(h)[:-1]
        runs = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        chosen, answers = merge(c, starts, runs)
        b, place, answers = b[chosen], place[chosen], answers[chosen]
        order = np.lexsort((place, b))
        b, place, answers = b[order], place[order].astype(np.uint64), answers[order]
        return packed_rows(np.full(len(b), key[0].as_py(), np.int32), b, place, answers, runs_of(b))

    return packed.groupBy("bucket").applyInArrow(run, PACKED)


Answer = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def answered(blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, Answer], pa.Table], n_buckets: int, schema: str) -> DataFrame:
    """``finish`` gets each block's documents, and a function from the block's
    sorted hashes to the answered ones' indices and their answers."""

    def run(docs, table):
        def answer(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            buckets, sizes = table["bucket"].to_numpy(), table["n"].to_pylist()
            firsts = np.searchsorted(buckets_of(hashes, n_buckets), buckets.astype(np.uint64)).tolist()
            places = [first + unpack_sorted(x, n).astype(np.int64) for first, x, n in zip(firsts, table["hashes"].to_pylist(), sizes)]
            values = [unpack64(x, n).view(np.int64) for x, n in zip(table["counts"].to_pylist(), sizes)]
            return (np.concatenate(places), np.concatenate(values)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        return finish(docs, answer)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
