"""Stored token trees, edited from a second table."""

import random

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import tokencount  # noqa: E402

LETTERS = "ab  \n\n'st12.,!éß漢 "


def edited(text, edits):
    for start, end, new in edits:
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        text = text[:start] + new + text[end:]
    return text


def test_query_against_full_counts(spark, sf):
    """Every row of the query: whole texts and edited texts encoded from scratch."""
    counter = tokencount.PieceCounter()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in tokencount.op9(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(t)
        now = edited(t, [(n // 2, n // 2, " [edited here] "), (0, 10, ""), (n - 3, n + 40, "the end.")])
        r = got[i]
        assert (r.n_pretokens, r.n_tokens) == (len(counter.split(t)), len(counter.encode(t)))
        assert (r.n_chars_edited, r.n_tokens_edited) == (len(now), len(counter.encode(now)))


def test_stored_trees_follow_a_table_of_edits(spark):
    rng, counter = random.Random(4), tokencount.PieceCounter()
    make = lambda n: "".join(rng.choices(LETTERS, k=n))
    texts = {i: make(rng.choice([0, 5, 300, 3000])) for i in range(40)} | {40: None}
    trees = tokencount.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    now = {i: t or "" for i, t in texts.items()}
    for _ in range(3):  # what one round of edits leaves is the next one's column
        edits = [(i, k, *sorted(rng.randint(0, 3100) for _ in range(2)), make(rng.choice([0, 1, 9, 900]))) for i in range(0, 41, 2) for k in range(rng.randint(1, 4))]
        edits = [(i, k, a, min(b, a + rng.choice([0, 2, 40, 4000])), new) for i, k, a, b, new in edits]
        rng.shuffle(edits)
        table = spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, replacement string")
        done = tokencount.apply_edits(tokencount.with_edits(trees, table))
        rows = done.collect()
        for i in now:
            now[i] = edited(now[i], [(a, b, new) for j, k, a, b, new in sorted(edits) if j == i])
        assert {r.doc_id: "".join(x.text for x in r.leaves) for r in rows} == now
        for r in rows:
            pieces = counter.split(now[r.doc_id])
            assert (r.n_chars_edited, r.n_tokens_edited) == (len(now[r.doc_id]), sum(counter[p] for p in pieces))
            assert all(x.n_chars == len(x.text) for x in r.leaves)
            assert sum(x.n_pretokens for x in r.leaves) == len(pieces)
            assert r.doc_id % 2 == 0 or r.n_reencoded == 0
        trees = spark.createDataFrame(rows, done.schema).select("doc_id", "leaves")


def test_edits_leave_other_leaves_unread():
    counter = tokencount.PieceCounter()
    tree = tokencount.TokenTree.of_text("some words " * 20_000, counter)
    column = tokencount._leaf_arrays([tree])
    stored = tokencount._stored_tree(column[0].values, counter)
    stored.edit(100_000, 100_005, "other")
    assert sum(leaf.pieces is not None for leaf in stored.leaves) <= 3 < len(stored.leaves) // 100
    assert stored.encoded < 30


def test_odd_edits(spark):
    rows = [(1, "abc def", None), (1, "abc def", []), (2, None, [(0, 5, "new")]), (3, "abc", [None, (None, None, None), (9, 2, "x")]), (None, "", [(-4, -2, "a b")])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokencount.EDITS}")
    trees = tokencount.build_trees(df)
    assert trees.count() == len(rows) and tokencount.build_trees(df.filter("false")).collect() == []
    from pyspark.sql import functions as F

    both = trees.withColumn("edits", F.when(F.col("doc_id") == 2, F.from_json(F.lit('[{"start":0,"end":5,"replacement":"new"}]'), tokencount.EDITS)))
    got = tokencount.apply_edits(both)
    assert {(r.doc_id, r.n_chars_edited) for r in got.collect()} == {(1, 7), (2, 3), (3, 3), (None, 0)}
    odd = trees.filter("doc_id = 3").withColumn("edits", F.from_json(F.lit('[null, {}, {"start":9,"end":2,"replacement":"x"}]'), tokencount.EDITS))
    (r,) = tokencount.apply_edits(odd).collect()
    assert "".join(x.text for x in r.leaves) == "abcx"
