"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that the merge list produces,
and reads one token per transition.  It starts as one state with a loop for
every base symbol.  Merges apply in order, each as a gadget, to what stands
then: merge (u, v) -> uv gives every state with a u-arc an uv-arc to where v
leads, and sends the u-arcs to a copy of their target that lacks the v-arc.  A
merge whose gadget finds no place (v can't follow u by then) is left out.

All arcs of one label share their target, so a state is named by the token read
last, and it starts as a copy of the state of that token's right part.  A state
therefore has all labels but those that copies took: where x was taken, x lacks,
and so do the labels that later gadgets made of x.  Labels are numbered in the
order of a tree, each below its left part, siblings in the order of their merges;
what a copy took is then a range of numbers.  So the transition table, which has
|V|^2 entries, is compiled into a sorted list of ranges for each state, and a
transition is a lookup there.

A prefix of a word has one tokenization, so after each symbol the automaton is in
one state: encoding goes through a pre-split word once, from left to right, and
finds for each prefix the one label that an earlier state has an arc for.
Decoding emits arc labels.

Defined cases: a null text is an empty one and gives no ids; special tokens are
found in the raw text, as the library does; a very long text takes memory in
proportion, and long words are not cached; an empty table gives an empty one;
repeated rows give repeated results; other columns, whatever their names, are not
read.  A tokenizer file of another make is refused.
"""

from __future__ import annotations

import array
import bisect
import functools
import hashlib
import json
import re
import sys

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts
from .secrets import tokenizer_file

#: Entries of the caches of a task, full ones start anew, and the longest that
#: they hold.
WORD_LIMIT, CHUNK_LIMIT, CACHED_CHARS = 150_000, 250_000, 48


def byte_symbols() -> list[str]:
    """Fixed table of byte-level BPE: printable bytes stand for themselves, the
    others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return out


class TokenizationAutomaton:
    """Transitions between tokens, compiled from a merge list.

    ``vocab``: token -> id; ``merges``: pairs of tokens in order; ``suffix``:
    what marks the last symbol of a word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.labels = {i: t for t, i in vocab.items()}
        #: For a merged token: the step of its gadget, and its two parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        #: For a token: what copies took from its state, and at which step.
        self.taken: dict[int, dict[int, int]] = {}
        void: set[int] = set()
        for step, (u, v) in enumerate(merges, 1):
            a, b, ab = vocab[u], vocab[v], vocab[u + v]
            if a in void or b in void or not self._stands(a, b):
                void.add(ab)
                continue
            self.taken.setdefault(a, {})[b] = step
            self.made[ab] = (step, a, b)
        vocab = {t: i for t, i in vocab.items() if i not in void}
        self._number(sorted(vocab.values()))
        self.rows: dict[int, list[int]] = {}
        #: Inside a word no label is marked as its end; at the end every label is.
        self.inner = {t: i for t, i in vocab.items() if not suffix or not t.endswith(suffix)}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in vocab.items() if not suffix or t.endswith(suffix)}
        self.longest = max(map(len, [*self.inner, *self.final]), default=0)

    def _stands(self, t: int, w: int) -> bool:
        """Has the state after ``t`` an arc ``w``, after the gadgets so far?"""
        born = sys.maxsize
        while True:
            if taken := self.taken.get(t):
                x, until = w, sys.maxsize  # x went before w was made of it, or since
                while True:
                    if taken.get(x, sys.maxsize) < min(born, until):
                        return False
                    if x not in self.made:
                        break
                    step, x, _ = self.made[x]
                    until = step + 1
            if t not in self.made:
                return True
            born, _, t = self.made[t]  # its state began as a copy of its right part's

    def _number(self, tokens: list[int]) -> None:
        """Numbers of labels, each followed by those made of it as left part."""
        below: dict[int, list[int]] = {}
        for w, (_, left, _) in self.made.items():
            below.setdefault(left, []).append(w)  # in the order of their steps
        self.below = below
        self.number: dict[int, int] = {}
        self.end: dict[int, int] = {}
        for top in tokens:
            if top in self.made:
                continue
            open_ = [(top, iter(below.get(top, ())))]
            self.number[top] = len(self.number)
            while open_:
                token, rest = open_[-1]
                child = next(rest, None)
                if child is None:
                    self.end[token] = len(self.number)
                    open_.pop()
                else:
                    self.number[child] = len(self.number)
                    open_.append((child, iter(below.get(child, ()))))

    def row(self, t: int) -> list[int]:
        """The state after ``t``: bounds of the ranges of labels that it lacks."""
        found = self.rows.get(t)
        if found is None:
            ranges, born, at = [], sys.maxsize, t
            while True:
                for x, step in self.taken.get(at, {}).items():
                    if step < born:
                        ranges.append((self.number[x], self.number[x] + 1))
                        made = self.below.get(x, ())
                        later = bisect.bisect_left(made, step, key=lambda w: self.made[w][0])
                        if later < len(made):
                            ranges.append((self.number[made[later]], self.end[x]))
                if at not in self.made:
                    break
                born, _, at = self.made[at]
            bounds: list[int] = []
            for lo, hi in sorted(ranges):
                if bounds and lo <= bounds[-1]:
                    bounds[-1] = max(bounds[-1], hi)
                else:
                    bounds += (lo, hi)
            found = self.rows[t] = bounds
        return found

    def allowed(self, t: int, w: int) -> bool:
        """Has the state after ``t`` an arc labelled ``w``?"""
        return not bisect.bisect_right(self.row(t), self.number[w]) & 1

    def encode_word(self, word: str) -> list[int]:
        """The ids of a pre-split word, given as symbols without the end mark."""
        if word in self.final:
            return [self.final[word]]
        n, longest, number, rows, right = len(word), self.longest, self.number, self.rows, bisect.bisect_right
        #: The state after each prefix, and where its last token begins.
        states, begins = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            labels = self.final if end == n else self.inner
            for begin in range(end - longest if end > longest else 0, end):
                token = labels.get(word[begin:end])
                if token is None:
                    continue
                if begin:
                    state = states[begin]
                    if state < 0:
                        continue
                    row = rows.get(state)
                    if right(self.row(state) if row is None else row, number[token]) & 1:
                        continue
                states[end], begins[end] = token, begin
                break
        if n and states[n] < 0:
            raise ValueError(f"no path for {word[:80]!r}")
        tokens, at = [], n
        while at:
            tokens.append(states[at])
            at = begins[at]
        return tokens[::-1]


#: Fixed pattern of the vocabulary's pre-split, and its normalizers.  Under these,
#: texts of the characters in PLAIN are their own NFC, and no word crosses the white
#: space where ``str.split`` parts them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN = re.compile("[\t-\r -\u012f\u0132-\u017f]*")


def pattern_of(spec: dict) -> str:
    """The pre-split pattern of a tokenizer file; refuses what this module doesn't do."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model, added = spec["model"], spec["added_tokens"]
    plain_model = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    splits = len(steps) == 2 and steps[0]["type"] == "Split" and "Regex" in steps[0]["pattern"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    symbols = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    marks = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain_model and splits and symbols and marks) or spec.get("decoder"):
        raise ValueError("this tokenizer file is of a kind that isn't supported")
    return steps[0]["pattern"]["Regex"]


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str) -> tuple:
    """The automaton, the special tokens, the pre-split pattern, and whether the
    shortcut for plain texts holds; one per process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern, model = pattern_of(spec), spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    known = pattern == SPLIT and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
    return TokenizationAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or ""), special, pattern, known


class WordBpe:
    """Normalizes, splits, encodes and decodes texts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.automaton, self.special, pattern, self.shortcut = load_tokenizer(path)
        normalizer = Tokenizer.from_file(path).normalizer
        self.normalize = normalizer.normalize_str if normalizer else str
        self.split = regex.compile(pattern).findall
        self.symbols = byte_symbols()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.names = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.words: dict[str, bytes] = {}
        self.chunks = Chunks(self)

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        found = self.words.get(word)
        if found is None:
            symbols = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])
            found = pack(self.automaton.encode_word(symbols))
            if len(word) <= CACHED_CHARS:
                if len(self.words) > WORD_LIMIT:
                    self.words.clear()
                self.words[word] = found
        return found

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch without special tokens.

        No word crosses white space, so plain texts go chunk by chunk.
        """
        if self.shortcut and PLAIN.fullmatch(text):
            chunks = self.chunks
            if len(chunks) > CHUNK_LIMIT:
                chunks.clear()
            return b"".join([chunks[c] for c in text.split()])
        return b"".join([self.word(w) for w in self.split(self.normalize(text))])

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        found, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            found += [self.stretch(text[at : m.start()]), pack([self.special[m.group()]])]
            at = m.end()
        return b"".join([*found, self.stretch(text[at:] if at else text)])

    def decode(self, ids: bytes) -> str:
        """The labels of packed ids, parted by spaces; unknown ids have none."""
        names = self.names
        try:
            return " ".join([names[i] for i in unpack(ids)])
        except KeyError:
            return " ".join([names[i] for i in unpack(ids) if i in names])


class Chunks(dict):
    """White-space-free chunk -> the ids of its words."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join([self.bpe.word(w) for w in self.bpe.split(chunk.lower())])
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = found
        return found


def pack(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpack(ids: bytes) -> array.array:
    a = array.array("I")
    a.frombytes(ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _mapped(df: DataFrame, columns: str, row, id_col: str, value_col: str, path: str | None, kind: str = "string") -> DataFrame:
    """A narrow map with one ``WordBpe`` a task: id, then what ``row`` gives."""

    def make():
        bpe = WordBpe(path or tokenizer_file("word_bpe_49k.json"))
        return lambda ids, values: [(i, *row(bpe, v)) for i, v in zip(ids, values)]

    return map_texts(df, make, f"{field(df, id_col)}, {columns}", id_col, value_col, kind)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids packed as little-endian 32-bit integers."""

    def row(bpe: WordBpe, text: str | None) -> tuple:
        packed = bpe.encode(text or "")
        return len(packed) // 4, packed

    return _mapped(df, "n_tokens long, ids binary", row, id_col, text_col, path)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids as an array."""
    return _mapped(df, "ids array<int>", lambda bpe, text: (unpack(bpe.encode(text or "")).tolist(),), id_col, text_col, path)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, decoded: the text of a column of ids, packed or an array; null for null."""
    if df.schema[ids_col].dataType.typeName() == "array":
        return _mapped(df.select(id_col, F.col(ids_col).cast("array<long>")), "decoded string", lambda bpe, ids: (None if ids is None else bpe.decode(pack([i for i in ids if i is not None and 0 <= i < 1 << 32])),), id_col, ids_col, path, "array<long>")
    return _mapped(df, "decoded string", lambda bpe, ids: (None if ids is None else bpe.decode(ids),), id_col, ids_col, path, "binary")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, number and digest of the ids, digest of the text decoded from them.

    The digests are taken beside the encoder, so that ids of a long text never
    leave the task that made them.
    """

    def row(bpe: WordBpe, text: str | None) -> tuple:
        packed = bpe.encode(text or "")
        return len(packed) // 4, sha256(packed), sha256(bpe.decode(packed).encode("utf-8", "surrogatepass"))

    return _mapped(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, id_col, text_col, path)
