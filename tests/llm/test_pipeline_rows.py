"""The pipeline's filters decide for each row, whatever its id."""

import collections

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import decontaminate, neardup  # noqa: E402

LEAK = "the quick brown fox jumps over the lazy dog and then it sleeps"
WORDS = [f"w{k}" for k in range(80)]
COPY, NEAR, OTHER = " ".join(WORDS), " ".join(WORDS[:-1] + ["x"]), " ".join(reversed(WORDS))


def counted(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_contaminated_rows_go_by_text(spark):
    bench = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    rows = [(None, LEAK), (None, f"so {LEAK}"), (None, "clean"), (None, "clean"), (None, None), (1, LEAK), (1, "clean"), (2, "clean"), (2, "clean"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(decontaminate.drop_contaminated(docs, bench)) == collections.Counter(r for r in rows if LEAK not in (r[1] or ""))


def test_one_row_of_each_group_stays(spark):
    rows = [(None, COPY), (None, COPY), (None, NEAR), (5, COPY), (4, NEAR), (4, NEAR), (4, OTHER), (None, OTHER), (None, "only null ids"), (None, "only null ids"), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert counted(got) == collections.Counter([(4, NEAR), (4, OTHER), (None, "only null ids"), (9, None), (9, None), (None, "")])
    assert neardup.drop_near_duplicates(docs.filter("false")).collect() == []
