"""Rows of the block exchange, and ids of other types."""

import numpy as np
import pytest

pytest.importorskip("tablelens.llm")

from pyspark.sql import functions as F  # noqa: E402

from tablelens.llm import blocks, lm, substring  # noqa: E402


def test_rows_grow_with_blocks_and_not_with_their_square(spark, sf):
    def entries(docs):
        g = lm.BlockGrams(docs)
        order = np.argsort(g.hashes)
        return g.hashes[order], g.counts()[order]

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {}
    for n in (4, 16, 64):
        packed = blocks.block_entries(blocks.with_block(docs, n, "doc_id", "text", F.lit(True).alias("train")), entries, 8)
        found[n] = packed.agg(F.count("*"), F.sum("n"), F.min("n"), F.max("bucket")).first()
        assert found[n][0] <= 8 * n and found[n][2] >= 1 and found[n][3] < 8
    assert found[64][0] <= 16 * found[4][0]


def test_a_row_never_stands_for_no_entry():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, np.int64).astype(np.uint64) * 2)
    table = blocks.to_buckets(3, h, np.arange(50), 1_000_000)
    assert table.num_rows <= 50 and sum(table["n"].to_pylist()) == 50
    back, counts, block, _ = blocks.collected(table)
    assert (back == h).all() and (counts == np.arange(50)).all() and (block == 3).all()


def test_ids_of_other_types(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [("b", passage), ("a", f"x {passage} y"), (None, passage), ("c", "short"), ("b", passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "~", r.n_removed) for r in substring.op7(docs).collect())
    assert got == [("a", 0), ("b", 60), ("b", 60), ("c", 0), ("~", 60)]
    assert sorted(r.doc_id or "~" for r in lm.op3(docs).collect()) == ["a", "b", "b", "c", "~"]
