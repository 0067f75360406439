"""Blocks of op3 and op7 under null and repeated ids."""

import collections

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import blocks, lm, substring  # noqa: E402

PASSAGE = " ".join(f"p{k}" for k in range(60))


def hot(n=300):
    """A third of the rows without id, a third with one id, the others with their own."""
    return [((None, 7, 100 + k)[k % 3], f"row{k} {PASSAGE}" if k % 10 == 0 else f"row{k} some words") for k in range(n)]


def test_no_id_fills_a_block(spark):
    df = spark.createDataFrame(hot(), "doc_id long, text string")
    got = collections.Counter(r.block for r in blocks.with_block(df, 10, "doc_id", "text").collect())
    assert len(got) == 10 and max(got.values()) < 70


def test_results_do_not_need_ids_together(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # the passage stays in rows of the smallest id that holds it
    removed = collections.Counter((r.doc_id, r.n_removed) for r in substring.op7(df).collect())
    least = min(i for i, t in rows if i is not None and PASSAGE in t)
    assert removed == collections.Counter((i, 60 if PASSAGE in t and i != least else 0) for i, t in rows)
    scored = lm.op3(df).collect()
    assert len(scored) == len(rows) and len({r.train_tokens for r in scored}) == 1
    by_shape = collections.defaultdict(set)
    for r in scored:
        by_shape[r.n_tokens, r.held_out].add(round(r.score, 9))
    assert all(len(v) == 1 for v in by_shape.values())
