"""Toxicity: a factorization machine over hashed terms.

z = w0 + sum w_i + sum over pairs <v_i, v_j> over the distinct terms of a text.
The factors learn which terms are toxic together, such as an insult with the
mention of a group, that a linear model has to rate alone.  The pair sum is linear
in the terms: (|sum v|^2 - sum |v|^2) / 2, so a text costs one addition per
distinct term.

Most terms of long texts carry noise only.  So w and v shrink apart, each by a
multiple of what chance makes of a term's gradient: that falls with the root of
the number of texts that hold the term, and for v grows with the other factors of
the text.  The factors start as large as their noise allows.  A second model
without pairs is trained beside; texts kept out of both decide, so pairs stay
only where they help.

The score is sigmoid(z + shift): kept-out texts also place the cut ``CUT`` where it
has the most toxic texts over it, a clean one over it costing ``CLEAN_COST``.  The
score orders texts and is cut at ``CUT``; it is no calibrated probability.

Defined cases: a null or empty text gives the score of the bias alone, far
below 0.7; without labels of both kinds every score is the share of toxic
labels, 0 where there is none; several labels of one document count as their
largest; documents that share an id share its label; a very long text counts its
distinct terms; an empty table gives an empty one; repeated rows give repeated
results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import dataclasses
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_bucket, field, map_texts
from .langid import labelled_sample

BUCKETS = 1 << 16
FACTORS = 4
#: Passes over the training texts, and over what shrinkage has left, hardly shrunk.
EPOCHS, REFIT, REFIT_SHRINK = 8, 6, 0.1
#: Bound of the training sample: texts of each label.
TEXTS_PER_LABEL = 2500
#: Terms in fewer training texts than this keep weight 0.
MIN_TEXTS = 5
CUT = 0.7
#: Shrinkage of w and of v, in deviations of a term's gradient by chance.
SHRINK_W, SHRINK_V = 2.0, 2.0
RATE_W, RATE_V = 0.2, 0.05
#: Variance of the pair sum of an average text that the factors start with.
START = 0.2
#: Share of the sample that chooses the model and places the cut, and what a clean
#: text over it costs.
KEPT_OUT, CLEAN_COST = 0.25, 20

TERM = re.compile(r"\w+")


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall(text.lower())) if text else set()


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclasses.dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray  # BUCKETS x (1 + FACTORS): w, then v

    def term_table(self) -> WordTable:
        def build(terms: list[str]) -> np.ndarray:
            x = self.weights[[bucket(t) for t in terms]]
            return np.column_stack([x, (x[:, 1:] ** 2).sum(1)])

        return WordTable(FACTORS + 2, build)

    def score(self, text: str | None, table: WordTable) -> float:
        terms = sorted(terms_of(text))
        z = self.bias
        if terms:
            total = table.total(terms)
            z += total[0] + ((total[1:-1] ** 2).sum() - total[-1]) / 2
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logits(bias: float, weights: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    out = []
    for _, f in rows:
        x = weights[f]
        out.append(bias + x[:, 0].sum() + ((x[:, 1:].sum(0) ** 2).sum() - (x[:, 1:] ** 2).sum()) / 2)
    return np.array(out)


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean())


def descend(rows: list[tuple[int, np.ndarray]], pairs: bool, seed: int) -> tuple[float, np.ndarray]:
    """Proximal AdaGrad over single texts: bias and weights."""
    rng = np.random.default_rng(seed)
    texts = np.bincount(np.concatenate([f for _, f in rows]), minlength=BUCKETS)
    p = float(np.clip(np.mean([y for y, _ in rows]), 1e-6, 1 - 1e-6))
    noise = np.sqrt(p * (1 - p) / np.maximum(texts, 1))
    weights = np.zeros((BUCKETS, 1 + FACTORS))
    if pairs:
        usable = texts > 0
        spread = np.sqrt(START / max(1.0, np.mean([len(f) for _, f in rows])))
        weights[usable, 1:] = rng.normal(0, spread, (usable.sum(), FACTORS))
    bias, seen_b, seen = float(np.log(p / (1 - p))), 1.0, np.full_like(weights, 0.05)
    rates = np.array([RATE_W] + [RATE_V] * FACTORS)
    for epoch in range(EPOCHS + REFIT):
        if epoch == EPOCHS:
            alive = np.abs(weights).sum(1) > 0
            rows, noise = [(y, f[alive[f]]) for y, f in rows], noise * REFIT_SHRINK
        for k in rng.permutation(len(rows)):
            y, f = rows[k]
            x = weights[f]
            total = x[:, 1:].sum(0)
            z = bias + x[:, 0].sum() + ((total**2).sum() - (x[:, 1:] ** 2).sum()) / 2
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            seen_b += g * g
            bias -= RATE_W * g / np.sqrt(seen_b)
            if not len(f):
                continue
            grad = np.empty_like(x)
            grad[:, 0] = g
            grad[:, 1:] = g * (total - x[:, 1:])
            seen[f] += grad**2
            step = rates / np.sqrt(seen[f])
            x = x - step * grad
            x[:, 0] = np.sign(x[:, 0]) * np.maximum(0, np.abs(x[:, 0]) - SHRINK_W * noise[f] * step[:, 0])
            if pairs:  # the factors of a term shrink together
                size = np.sqrt((x[:, 1:] ** 2).sum(1)) + 1e-12
                chance = SHRINK_V * noise[f] * np.sqrt((total**2).sum()) * np.sqrt((step[:, 1:] ** 2).mean(1))
                x[:, 1:] *= np.maximum(0, 1 - chance / size)[:, None]
            weights[f] = x
    return bias, weights


def train(samples: list[tuple[int, list[int]]], seed: int = 11, pairs: bool | None = None) -> FactorizationMachine:
    """``samples``: label, distinct term buckets.  ``pairs``: with or without; both
    are tried and the kept-out texts choose, unless it is given."""
    labels = np.array([y for y, _ in samples])
    if not len(labels) or labels.min() == labels.max():
        p = float(labels.mean()) if len(labels) else 0.0
        return FactorizationMachine(float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))), np.zeros((BUCKETS, 1 + FACTORS)))
    texts = np.bincount(np.concatenate([f for _, f in samples if len(f)] or [[0]]).astype(int), minlength=BUCKETS)
    usable = texts >= MIN_TEXTS
    rows = [(y, a[usable[a]]) for y, f in samples for a in [np.array(f, int)]]
    apart = np.random.default_rng(seed).random(len(rows)) < KEPT_OUT
    judges, rows = [r for r, k in zip(rows, apart) if k] or rows, [r for r, k in zip(rows, apart) if not k] or rows
    y = np.array([y for y, _ in judges])
    found = [descend(rows, with_pairs, seed) for with_pairs in ([True, False] if pairs is None else [pairs])]
    bias, weights = min(found, key=lambda m: log_loss(logits(*m, judges), y))
    return FactorizationMachine(bias + aligned(bias, weights, judges), weights)


def aligned(bias: float, weights: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> float:
    """How far to move the bias so that ``CUT`` parts texts best that weren't trained on.

    The best cut has the most toxic texts over it, each clean one over it costing
    ``CLEAN_COST``.
    """
    z, y = logits(bias, weights, rows), np.array([y for y, _ in rows])
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(np.where(y[order] == 1, 1, -CLEAN_COST))
    gain[:-1][z[order][:-1] == z[order][1:]] = -len(z) * CLEAN_COST  # no cut between equal values
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 0.0
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    return float(np.log(CUT / (1 - CUT)) - (z[order[best]] + below) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = TEXTS_PER_LABEL) -> FactorizationMachine:
    """Train on documents with a label; the sample is bounded by ``per_label``."""
    one = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample = labelled_sample(one, "label", id_col, per_label, 2)  # ids and labels, 2 x per_label rows at most
    texts = docs.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample), id_col).select("label", "text")

    def make():
        pack = lambda t: np.unique([bucket(w) for w in terms_of(t)]).astype("<i4").tobytes()
        return lambda ys, ts: [(y, pack(t)) for y, t in zip(ys, ts)]

    # packed, so that the driver holds the sample in about the size that it is sent in
    rows = sorted(tuple(r) for r in map_texts(chosen, make, "label int, f binary", "label", "text").collect())
    return train([(y, np.frombuffer(f, "<i4")) for y, f in rows])


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row: a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (1 + FACTORS) floats

    def make():
        m = shared.value
        table = m.term_table()
        return lambda ids, texts: [(i, m.score(t, table)) for i, t in zip(ids, texts)]

    return map_texts(docs, make, f"{field(docs, id_col)}, score double", id_col, text_col)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; labels with crc32(doc_id) mod 3 = 1 are not learned from."""
    model = fit_toxicity(docs, labels.filter(crc_bucket("doc_id", 3) != 1))
    return score_toxicity(docs, model).select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
