"""Shared plumbing: Arrow mapping over texts, word caches, block layout."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.cutting import checkpointed, written  # noqa: F401  used by the operators

#: Rows and text bytes handed to Python code at once (one row at least), so that
#: memory follows one slice of a batch and not the whole batch.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = bytes.maketrans(A_TO_Z.encode(), A_TO_Z.lower().encode())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def field(df: DataFrame, name: str) -> str:
    """``name type`` of a column, for building an output schema."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where a column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def apart(summary: DataFrame, *keys: str) -> DataFrame:
    """A summary by ``keys`` (longs) that a join with its table shuffles anew.

    Where a join finds the summary already dealt by its keys, aggregation and join
    run as one stage, and Spark can't split the other side's hot keys.  Keys that
    are expressions hide how the rows are dealt.
    """
    return summary.withColumns({k: F.bitwise_not(F.bitwise_not(F.col(k))) for k in keys})


def text_keys(text: Column) -> list[Column]:
    """k1, k2: 128 bits of hash that tell texts apart; equal texts have equal ones."""
    return [F.xxhash64(F.lit(k), text.cast("string")).alias(f"k{k}") for k in (1, 2)]


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and about SLICE_BYTES of text."""
    texts = batch.column(text_at)
    length = pc.list_value_length if pa.types.is_list(texts.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        end = min(max(full, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def rows_to_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list], list[tuple]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    text_type: str = "string",
) -> DataFrame:
    """One output row per input row: ``make()`` runs once per task and returns
    a function from (ids, texts) to rows of ``schema``.

    No shuffle; the task keeps a slice of rows at a time.  An empty table gives
    an empty table, repeated rows give repeated results.
    """
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        fn = make()
        for batch in batches:
            for part in slices(batch, 1):
                yield rows_to_batch(
                    fn(part.column(0).to_pylist(), part.column(1).to_pylist()), arrow
                )

    return df.select(F.col(id_col), F.col(text_col).cast(text_type)).mapInArrow(run, out)


class WordTable:
    """word -> row of a float matrix; ``build`` makes the rows of new words.

    About ``limit`` words are held; beyond it the table starts anew, which costs
    time and changes no result.
    """

    #: Words looked up at a time.
    PART = 50_000

    def __init__(self, width: int, build: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.width, self.build, self.limit = width, build, limit
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.data = np.zeros((1024, self.width))

    def total(self, words: Sequence[str]) -> np.ndarray:
        """The sum of the rows of ``words``."""
        out = np.zeros(self.width)
        for at in range(0, len(words), self.PART):
            places = self._places(words[at : at + self.PART])  # may renew the data
            out += self.data[places].sum(0)
        return out

    def _places(self, words: Sequence[str]) -> list[int]:
        if len(self.rows) > self.limit:
            self._reset()
        rows = self.rows
        try:
            return [rows[w] for w in words]
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in rows]
        at = len(rows)
        while at + len(new) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[at : at + len(new)] = self.build(new)
        rows.update(zip(new, range(at, at + len(new))))
        return [rows[w] for w in words]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def block_counts(df: DataFrame, text_col: str, *sizes: int) -> list[int]:
    """For each size, parts of about so much text, at least one per shuffle partition."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [max(math.ceil(total / size), least) for size in sizes]
