"""Pairs: learned where only they carry the label, dropped where they don't help."""

import random

import numpy as np
import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import toxicity  # noqa: E402


def either_or(n, seed):
    """Toxic if exactly one of two words is there: neither tells anything alone."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        kind = rng.randrange(4)
        words = {*rng.choices([f"word{k}" for k in range(200)], k=30), *[(), ("insult",), ("group",), ("insult", "group")][kind]}
        out.append((int(kind in (1, 2)), " ".join(sorted(words))))
    return out


def samples(rows):
    return [(y, sorted({toxicity.bucket(w) for w in toxicity.terms_of(t)})) for y, t in rows]


def auc(model, rows):
    table = model.term_table()
    scores = {1: [], 0: []}
    for y, t in rows:
        scores[y].append(model.score(t, table))
    low = np.sort(scores[0])
    return np.mean([(np.searchsorted(low, s) + np.searchsorted(low, s, "right")) / 2 for s in scores[1]]) / len(low)


def test_an_exclusive_or_needs_pairs():
    train, held = either_or(2400, 1), either_or(800, 2)
    assert auc(toxicity.train(samples(train)), held) > 0.97
    assert auc(toxicity.train(samples(train), pairs=False), held) < 0.6


def test_pairs_go_where_single_terms_say_all():
    rng = random.Random(3)

    def texts(n):
        out = []
        for _ in range(n):
            words = rng.choices([f"word{k}" for k in range(3000)], k=80)
            toxic = rng.random() < 0.2
            out.append((int(toxic), " ".join(words + (rng.choices(["idiot", "clown", "fool"], k=2) if toxic else []))))
        return out

    train, held = texts(1500), texts(600)
    whole, single = toxicity.train(samples(train)), toxicity.train(samples(train), pairs=False)
    assert auc(whole, held) > 0.98 and auc(whole, held) > auc(single, held) - 0.01
    assert auc(whole, [(0, ""), (1, "idiot clown")]) == 1


def test_held_out_labels(spark, sf):
    """On the tables: ordering of held-out labelled documents, and few clean ones over the cut."""
    from pyspark.sql import functions as F

    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op4(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col("toxic").alias("y")).collect()
    low = np.sort([r.score for r in got if r.y == 0])
    assert np.mean([np.searchsorted(low, r.score) for r in got if r.y == 1]) / len(low) > 0.96
    assert np.mean([r.predicted for r in got if r.y == 1]) > 0.6
    assert np.mean([r.predicted for r in got if r.y == 0]) < 0.01
