"""Decontamination gives one result for each row."""

import collections

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import decontaminate  # noqa: E402

ITEMS = [(k, " ".join(f"i{k}w{j}" for j in range(14))) for k in range(40)]
LEAK = "x " + ITEMS[3][1]
ROWS = [(None, LEAK), (None, LEAK), (None, "clean"), (None, "clean"), (None, None), (1, LEAK), (1, LEAK), (1, "clean"), (2, "clean"), (2, "clean"), (2, None), (2, None), (3, "")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.mark.parametrize("most_flags", [decontaminate.MOST_FLAGS, 9, 7])
def test_every_row_gives_one_result(rows, bench, most_flags):
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.find_benchmark_hits(rows, bench, most_flags=most_flags).collect())
    assert got == collections.Counter((i, len((t or "").split()), *((14, 1) if t == LEAK else (0, 0))) for i, t in ROWS)
    assert decontaminate.op6(rows, bench.filter("false")).count() == decontaminate.op6(rows, bench).count() == len(ROWS)
