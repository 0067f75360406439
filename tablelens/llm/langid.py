"""Language ID: averaged hashed subword embeddings under a linear softmax.

A word's features are itself and its letter n-grams, hashed into ``BUCKETS``
embeddings; a text is the mean embedding of all features of all its words, and
a linear layer with softmax gives the language.  Stochastic gradient descent in
numpy trains both on a bounded sample of labelled texts.

A fifth of the sampled texts, with all pieces of them, is kept out and calibrates:

- a temperature gives the probabilities of least log loss, against targets that
  leave each class its share of one in n + 2 (so that a faultless classifier has a
  best temperature too);
- a gate tells texts of a learned language that got their label from others: a
  logistic regression on the margin of the best class and on the share of letter
  trigrams that the training has seen, fitted against wrongly labelled texts and
  against kept-out texts whose letters are shuffled.  A text is rejected where the
  gate finds it likelier not to be one, whatever the number of languages.

As the layer is linear, a feature adds a fixed vector of class scores to a
text: tasks hold those (BUCKETS x classes floats, whatever the input's size) and
add up words.

Defined cases: a null text or one without a letter (of Unicode's category L) gives
``und`` with score 0 and is rejected; without any labelled text every text gives
``und``; ties go to the first language in order; a very long text is summed up
word by word; repeated rows give repeated results; an empty table gives an empty
one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import dataclasses
import random
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_bucket, field, map_texts, slices

#: Embeddings, and bits that tell which trigrams the training has seen.
BUCKETS, KNOWN = 1 << 14, 1 << 20
DIM = 16
EPOCHS = 6
#: Bounds of the training sample: texts of each language, and languages (the most
#: frequent ones; a rarer one is not learned, and its texts are for the gate).
TEXTS_PER_LANGUAGE = 400
MAX_LANGUAGES = 200
#: Words of the short pieces that the model also learns from.
PIECE_WORDS = 6
#: One text in so many is kept out of the training.
KEPT_OUT = 5

LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Grams(dict):
    """n-gram -> its hash; starts anew when full."""

    LIMIT = 300_000

    def __missing__(self, gram: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        code = self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass"))
        return code


def subwords(word: str, grams: Grams) -> list[int]:
    """Hashes of the word, of its 2-grams, and of its trigrams (one a letter), edges marked."""
    marked, n = f"<{word}>", len(word)
    own = zlib.crc32(marked.encode("utf-8", "surrogatepass"))
    return [own, *[grams[marked[i : i + 2]] for i in range(n + 1)], *[grams[marked[i : i + 3]] for i in range(n)]]


def of_trigrams(words: list[str]) -> np.ndarray:
    """Which of the words' hashes, one word after the other, are trigrams'."""
    sizes = np.array([len(w) for w in words])
    return np.repeat(np.tile([False, True], len(sizes)), np.stack([sizes + 2, sizes], axis=1).ravel())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclasses.dataclass
class Sample:
    """A text's features: distinct buckets and their counts, trigrams likewise.
    ``language`` is None for a text that is of none."""

    language: str | None
    kept_out: bool
    features: np.ndarray
    counts: np.ndarray
    trigrams: np.ndarray
    trigram_counts: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.features, self.counts, self.trigrams, self.trigram_counts

    @classmethod
    def of_words(cls, language: str | None, kept_out: bool, words: list[str]) -> Sample:
        grams = Grams()
        codes = np.array([c for w in words for c in subwords(w, grams)], np.int64)
        return cls(language, kept_out, *np.unique(codes % BUCKETS, return_counts=True), *np.unique(codes[of_trigrams(words)] % KNOWN, return_counts=True))


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: what a feature adds
    bias: np.ndarray
    known: np.ndarray  # KNOWN booleans: trigrams of the training
    temperature: float = 1.0
    #: Weights of the gate: constant, margin, share of known trigrams.
    gate: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def word_table(self) -> WordTable:
        grams = Grams()

        def build(words: list[str]) -> np.ndarray:
            found = [subwords(w, grams) for w in words]
            codes, n = np.array([c for f in found for c in f], np.int64), np.array([len(f) for f in found])
            starts = np.cumsum(n) - n
            seen = self.known[codes % KNOWN] & of_trigrams(words)
            sums = np.add.reduceat(self.scores[codes % BUCKETS], starts, axis=0)
            return np.column_stack([sums, n, np.add.reduceat(seen.astype(float), starts), n // 2 - 1])

        return WordTable(len(self.languages) + 3, build)

    def judge(self, sums: np.ndarray, n: float, known: float, trigrams: float) -> tuple[int, float, float]:
        """The best class, its calibrated probability, and the gate's probability."""
        z = (sums / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        x = np.array([1.0, margin(z), known / trigrams])
        return best, float(p[best]), float(logistic(x @ np.array(self.gate)))

    def predict(self, text: str | None, table: WordTable) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the text is rejected."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0, True
        total = table.total(words)
        best, p, belongs = self.judge(total[:-3], *total[-3:])
        return self.languages[best], p, belongs < 0.5


def margin(z: np.ndarray) -> float:
    """How far the best class is ahead of the second, on a scale that flattens out."""
    if len(z) < 2:
        return 0.0
    second, best = np.partition(z, -2)[-2:]
    return float(np.log1p(best - second))


def train(samples: list[Sample], seed: int = 7) -> LanguageModel:
    languages = sorted({s.language for s in samples if s.language is not None})
    named = [s for s in samples if s.language is not None and len(s.features)]
    fit = [s for s in named if not s.kept_out] or named
    known = np.zeros(KNOWN, bool)
    if not named:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), known)
    rng = np.random.default_rng(seed)
    rows = [(languages.index(s.language), s.features, s.counts / s.counts.sum()) for s in fit]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(languages)))
    bias = np.zeros(len(languages))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            y, f, share = rows[k]
            rate = 0.5 * (1 - done / steps)
            done += 1
            mean = share @ emb[f]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * g * 0.1
            # a feature's step follows its share, scaled by the text's width
            emb[f] -= rate * min(len(f), 60) * np.outer(share, back)
    for s in fit:
        known[s.trigrams] = True
    model = LanguageModel(languages, emb @ out, bias, known)
    judges = [s for s in samples if s.kept_out and len(s.features)]
    return calibrate(model, judges if any(s.language is not None for s in judges) else named)


def calibrate(model: LanguageModel, rows: list[Sample]) -> LanguageModel:
    """Fit the temperature and the gate on texts that weren't trained on."""
    named = [s for s in rows if s.language is not None]
    z = np.array([s.counts @ model.scores[s.features] / s.counts.sum() + model.bias for s in named])
    y = np.array([model.languages.index(s.language) for s in named])
    if len(model.languages) > 1:
        left = 1 / (len(y) + 2)
        target = np.full(z.shape, left / (len(model.languages) - 1))
        target[np.arange(len(y)), y] = 1 - left

        def loss(t: float) -> float:
            x = z / t
            x = x - x.max(1, keepdims=True)
            return -(target * (x - np.log(np.exp(x).sum(1, keepdims=True)))).sum(1).mean()

        low, high = 1e-3, 1e3
        for _ in range(6):  # ever finer grids around the best
            grid = np.geomspace(low, high, 25)
            k = int(np.argmin([loss(t) for t in grid]))
            low, high = grid[max(0, k - 1)], grid[min(24, k + 1)]
        model.temperature = float(np.sqrt(low * high))
    points, belongs = [], []
    for s in rows:
        z = (s.counts @ model.scores[s.features] / s.counts.sum() + model.bias) / model.temperature
        points.append((1.0, margin(z), model.known[s.trigrams] @ s.trigram_counts / s.trigram_counts.sum()))
        belongs.append(s.language is not None and model.languages[int(z.argmax())] == s.language)
    model.gate = fit_gate(np.array(points), np.array(belongs))
    return model


def fit_gate(x: np.ndarray, belongs: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, both kinds of texts weighing the same,
    against targets short of 0 and 1 (Platt's), so that it ends."""
    n1, n0 = int(belongs.sum()), int((~belongs).sum())
    if not n1 or not n0:
        return 1.0 if n1 else -1.0, 0.0, 0.0
    target = np.where(belongs, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(belongs, 0.5 / n1, 0.5 / n0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = logistic(x @ w)
        slope = x.T @ (weight * (p - target)) + 1e-6 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def labelled_sample(docs: DataFrame, lang_col: str, id_col: str, per_class: int, max_classes: int = MAX_LANGUAGES) -> DataFrame:
    """About ``per_class`` rows of every label, chosen by a hash of the id.

    The share kept of a label is per_class / its count, so the result is
    bounded by per_class x max_classes whatever the input's size, and the
    choice needs counts only: no sort and no gathering of a label's rows.
    """
    counts = docs.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_classes).collect()
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(lang_col) == value, min(1.0, per_class / n)).otherwise(share)
    point = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(point < share)


def shuffled(words: list[str], seed: int) -> list[str]:
    """The words with all their letters dealt anew: their sizes, but no language."""
    letters = list("".join(words))
    random.Random(seed).shuffle(letters)
    out, at = [], 0
    for w in words:
        out.append("".join(letters[at : at + len(w)]))
        at += len(w)
    return out


def samples_of(language: str, text: str | None) -> list[Sample]:
    """A text and a short piece of it; of a kept-out one, both shuffled as well."""
    words = words_of(text)
    if not words:
        return []
    code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    kept_out, at = code % KEPT_OUT == 0, code // KEPT_OUT % len(words)
    piece = words[at : at + PIECE_WORDS]
    out = [Sample.of_words(language, kept_out, w) for w in (words, piece)]
    return out + [Sample.of_words(None, True, shuffled(w, code)) for w in (words, piece) if kept_out]


def training_rows(sample: DataFrame, lang_col: str, text_col: str) -> list[Sample]:
    """Features of the sampled texts, made in tasks."""

    def make():
        def rows(langs, texts):
            found = [s for lang, text in zip(langs, texts) for s in samples_of(lang, text)]
            return [(s.language, s.kept_out, *(x.astype("<i4").tobytes() for x in s.arrays())) for s in found]

        return rows

    # packed, so that the driver holds the sample in about the size that it is sent in
    schema = f"{field(sample, lang_col)}, kept_out boolean, f binary, c binary, t binary, tc binary"
    found = sorted((tuple(r) for r in map_texts(sample, make, schema, lang_col, text_col).collect()), key=lambda r: (r[0] or "", *r[1:]))
    return [Sample(lang, kept, *(np.frombuffer(x, "<i4") for x in rest)) for lang, kept, *rest in found]


def fit_languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = TEXTS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Train on rows with text and label.

    The sample is bounded: about ``per_language`` texts of each of the
    ``max_languages`` most frequent languages.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return train(training_rows(labelled_sample(labelled, lang_col, id_col, per_language, max_languages), lang_col, text_col))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected of every row: a narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MAX_LANGUAGES floats at most

    def make():
        m = shared.value
        table = m.word_table()
        return lambda ids, texts: [(i, *m.predict(t, table)) for i, t in zip(ids, texts)]

    return map_texts(docs, make, f"{field(docs, id_col)}, lang_pred string, score double, rejected boolean", id_col, text_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language the model doesn't reject, columns unchanged."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        table = m.word_table()
        for batch in batches:
            for part in slices(batch, at):
                kept = [not m.predict(t, table)[2] for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1(docs: DataFrame) -> DataFrame:
    """Every document's language; only crc32(doc_id) mod 3 other than 1 is learned from."""
    model = fit_languages(docs.filter(crc_bucket("doc_id", 3) != 1))
    return identify_languages(docs, model).withColumn("held_out", crc_bucket("doc_id", 3) == 1)
