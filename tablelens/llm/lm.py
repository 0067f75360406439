"""LM scoring: a weighted backoff automaton over smoothed n-grams.

States are the contexts: none (every word has an arc there, weighted with its
smoothed unigram probability) and one word.  The arc (h, w) of a seen bigram
weighs (c(hw) + MU p(w)) / (c(h) + MU), which is the unigram model taken as a
Dirichlet prior of the bigram model; the failure arc of h weighs MU / (c(h) +
MU) and leads to the state without context, so an unseen bigram costs a failure
arc and a unigram arc.  The weights of every state sum to one over the
vocabulary and an unknown word.  A text is one traversal from left to right.

Counts come from all training documents (see ``blocks``): a block gets those of
its own n-grams, and so builds the part of the automaton that its texts can
reach.  N-grams are told apart by 64-bit hashes: among n distinct ones two are
taken for one with probability n^2 / 2^65, which would add up their counts.

Defined cases: a null text is an empty one and has one token, its end; without
any training document all counts are 0 and every token costs log10(1 / 1) = 0; a
very long text is one document of its block; ids of any type pass through, null and
repeated ones too; rows of one id and text share a block; repeated rows count and
score as rows; an empty table gives an empty one; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import PACKED, Answer, BlockWords, answered, block_entries, collected, merged_answers, runs_of, split_words, to_buckets, with_block
from .common import block_counts, crc_bucket, field, splitmix

MU = 500.0
#: Text bytes of a block, whose automaton takes about forty times that in a task,
#: and text bytes whose entries make a bucket.
BLOCK_TEXT, BUCKET_TEXT = 5 << 20, 10 << 20
#: Distinct words that a task counts before it sends them on.
FLUSH_WORDS = 400_000
END = np.uint64(0x6A09E667F3BCC909)
UNIGRAM, BIGRAM = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)


class BlockGrams:
    """Tokens of a block's documents as local numbers, and their n-grams.

    Number ``end`` is the end of a text, and as a context its start.
    """

    def __init__(self, docs: pa.Table):
        words = BlockWords(docs["text"].to_pylist(), lower=True)
        n_docs, self.end = docs.num_rows, len(words.hashes)
        self.n_words = self.end + 1
        self.word_hashes = np.append(words.hashes, END)
        self.starts = words.starts + np.arange(n_docs + 1)
        self.ids = np.full(int(self.starts[-1]), self.end, np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[self.starts[1:] - 1] = False
        self.ids[inner] = words.ids
        before = np.full(len(self.ids), self.end, np.int64)
        before[1:] = self.ids[:-1]
        before[self.starts[:-1]] = self.end
        train = np.repeat(np.array(docs["train"].to_pylist(), bool), np.diff(self.starts))
        self.keys, at = np.unique(before * self.n_words + self.ids, return_inverse=True)
        self.bigrams = np.bincount(at[train], minlength=len(self.keys))
        self.unigrams = np.bincount(self.ids[train], minlength=self.n_words)
        h = self.word_hashes
        with np.errstate(over="ignore"):
            pairs = splitmix(h[self.keys // self.n_words] * BIGRAM) + h[self.keys % self.n_words]
        self.hashes = np.concatenate([splitmix(h ^ UNIGRAM), splitmix(pairs ^ BIGRAM)])

    def counts(self) -> np.ndarray:
        return np.concatenate([self.unigrams, self.bigrams]).astype(np.int64)


class BackoffAutomaton:
    """States, arcs and failure arcs with log10 weights, over local word numbers.

    ``unigrams``: count by word; ``bigrams``: count by context * n + word, seen
    ones only; ``contexts``: count by context.
    """

    def __init__(self, unigrams: np.ndarray, contexts: np.ndarray, keys: np.ndarray, bigrams: np.ndarray, total: int, vocabulary: int, mu: float = MU):
        self.n = len(unigrams)
        p = (unigrams + 1.0) / (total + vocabulary + 1.0)
        self.unigram_arcs = np.log10(p)
        self.unigram_list = self.unigram_arcs.tolist()
        self.failure_arcs = np.log10(mu / (contexts + mu)).tolist()
        seen = bigrams > 0
        keys, bigrams = keys[seen], bigrams[seen]
        weights = np.log10((bigrams + mu * p[keys % self.n]) / (contexts[keys // self.n] + mu))
        self.arcs: dict[int, float] = dict(zip(keys.tolist(), weights.tolist()))

    def score(self, words: list[int], start: int) -> float:
        """log10 probability of ``words`` from state ``start``."""
        n, arc, failure, unigram = self.n, self.arcs.get, self.failure_arcs, self.unigram_list
        total, state = 0.0, start
        for w in words:
            weight = arc(state * n + w)
            total += failure[state] + unigram[w] if weight is None else weight
            state = w
        return total


def training_totals(df: DataFrame, train: Column, text_col: str, n_buckets: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training documents, ends included.

    Tasks count the words of what they scan and send each word's hash once per
    ``FLUSH_WORDS`` distinct ones, so no text moves.
    """

    def entries(number: dict[bytes, int], counts: list[int], ends: int) -> pa.Table:
        h = np.append(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number)), END)
        order = np.argsort(h)
        return to_buckets(0, h[order], np.append(np.array(counts, np.int64), ends)[order], n_buckets)

    def scan(batches):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        counts, ends = np.zeros(0, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([number[w] for w in split_words(text, lower=True)], np.int64)
                if len(counts) < len(number):
                    counts = np.concatenate([counts, np.zeros(2 * len(number) - len(counts), np.int64)])
                np.add.at(counts, ids, 1)
                ends += 1
                if len(number) > FLUSH_WORDS:
                    yield from entries(number, counts[: len(number)], ends).to_batches()
                    number.clear()
                    counts[:], ends = 0, 0
        yield from entries(number, counts[: len(number)], ends).to_batches()

    def merge(key, table):
        h, c, _, _ = collected(table)
        starts = runs_of(h)[:-1]
        seen = np.add.reduceat(c, starts) if len(starts) else c
        return pa.table({"n": pa.array([int(seen.sum())], pa.int64()), "v": pa.array([int((seen > 0).sum())], pa.int64())})

    packed = df.filter(train).select(F.col(text_col).cast("string")).mapInArrow(scan, PACKED)
    n, v = packed.groupBy("bucket").applyInArrow(merge, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (the automaton) of every row; learned from the rows where ``train``.
    """
    n_blocks, n = block_counts(df, text_col, BLOCK_TEXT, BUCKET_TEXT)
    blocks = with_block(df, n_blocks, id_col, text_col, F.coalesce(train, F.lit(False)).alias("train"))
    total, vocabulary = training_totals(df, train, text_col, n)

    def entries(docs: pa.Table):
        g = BlockGrams(docs)
        order = np.argsort(g.hashes)
        return g.hashes[order], g.counts()[order]

    def merge(counts: np.ndarray, starts: np.ndarray, runs: np.ndarray):
        others = (np.add.reduceat(counts, starts)[runs] if len(starts) else counts) - counts
        return others > 0, others

    out = f"{field(blocks, 'id')}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = T.StructType.fromDDL(out)

    def finish(docs: pa.Table, answer: Answer) -> pa.Table:
        g = BlockGrams(docs)
        counts = g.counts()
        order = np.argsort(g.hashes)
        places, others = answer(g.hashes[order])
        counts[order[places]] += others
        unigrams, bigrams = counts[: g.n_words], counts[g.n_words :]
        automaton = BackoffAutomaton(unigrams, unigrams, g.keys, bigrams, total, vocabulary, mu)
        base = np.add.reduceat(automaton.unigram_arcs[g.ids], g.starts[:-1]) if docs.num_rows else np.zeros(0)
        known = np.add.reduceat((unigrams > 0)[g.ids].astype(np.int64), g.starts[:-1]) if docs.num_rows else np.zeros(0, np.int64)
        scores = [automaton.score(g.ids[a:b].tolist(), g.end) for a, b in zip(g.starts, g.starts[1:])]
        return pa.Table.from_arrays([docs["id"], pa.array(np.diff(g.starts)), pa.array(known), pa.array([total] * docs.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], schema=to_arrow_schema(schema))

    answers = merged_answers(block_entries(blocks, entries, n), merge)
    return answered(blocks, answers, finish, n, out).withColumnRenamed("id", id_col)


def op3(docs: DataFrame) -> DataFrame:
    """Scores of all documents; crc32(doc_id) mod 7 = 2 is held out."""
    scored = score_texts(docs, crc_bucket("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
