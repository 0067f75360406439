"""Token counts that follow edits: a kept segment tree of pre-tokens per document.

A text splits into pre-tokens, each encoded by itself, so a text's count is a
sum.  A tree has leaves of about ``LEAF`` pre-tokens, each with its text and
counts, under subtree sums of characters, tokens and pre-tokens.  ``build_trees``
gives the trees as a column that can be stored; ``apply_edits`` takes trees and
edits, and reads, splits and encodes only the leaves that an edit touches.

An edit descends by characters to its first leaf, splits anew from a little
before it until a boundary meets an old one again, and updates the sums on the
way up.  The split at a position depends on the text from there on only, and a
pre-token is decided at most two characters behind its end: so nothing before
the restart and nothing after the meeting can change.  A leaf that has grown over
twice its size is parted.

Defined cases: a null text is an empty one with count 0; edits are (start, end,
replacement) in code points of the text as it stands then, clipped to it, applied
in the order given; a null edit list changes nothing, and so does a null edit;
nulls in an edit are 0, 0 and an empty text; repeated rows give repeated results;
a very long text has many leaves and is built alone; an empty table gives an
empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import field, slices, written
from .secrets import encoding

LEAF = 64
#: Characters before an edit from which pre-tokens are split anew, and characters
#: behind a pre-token that decide its end.
CONTEXT, AHEAD = 3, 2
#: Pre-tokens whose count a task keeps, and the longest kept.
PIECE_LIMIT, CACHED_CHARS = 200_000, 64

LEAVES = "array<struct<text:string,n_chars:int,n_tokens:int,n_pretokens:int>>"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class PieceCounter(dict):
    """pre-token -> its number of tokens."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers

        super().__init__()
        self.encode = encoding(vocabulary).encode_ordinary
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= CACHED_CHARS:
            if len(self) > PIECE_LIMIT:
                self.clear()
            self[piece] = n
        return n


class Leaf:
    """Pre-tokens side by side; their text is fetched and split when first touched."""

    __slots__ = ("fetch", "counts", "pieces")

    def __init__(self, fetch, counts: np.ndarray, pieces: list[str] | None = None):
        self.fetch, self.counts, self.pieces = fetch, counts, pieces

    @property
    def text(self) -> str:
        return "".join(self.pieces) if self.pieces is not None else self.fetch()


class TokenTree:
    """Leaves of one text under subtree sums of (characters, tokens, pre-tokens)."""

    def __init__(self, leaves: list[Leaf], counter: PieceCounter):
        self.counter = counter
        #: Pre-tokens encoded by edits, so far.
        self.encoded = 0
        self._plant(leaves)

    @classmethod
    def of_text(cls, text: str, counter: PieceCounter) -> TokenTree:
        pieces = counter.split(text)
        return cls([cls._leaf(pieces[k : k + LEAF], counter) for k in range(0, len(pieces), LEAF)], counter)

    @staticmethod
    def _leaf(pieces: list[str], counter: PieceCounter) -> Leaf:
        return Leaf(None, np.array([sum(map(len, pieces)), sum([counter[p] for p in pieces]), len(pieces)], np.int64), pieces)

    def _plant(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves or [Leaf(None, np.zeros(3, np.int64), [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + len(self.leaves)] = [leaf.counts for leaf in self.leaves]
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 3).sum(1)
            level //= 2

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pieces(self) -> int:
        return int(self.sums[1, 2])

    def pieces(self, k: int) -> list[str]:
        leaf = self.leaves[k]
        if leaf.pieces is None:
            text, behind, at = leaf.text, "", k + 1
            while len(behind) < AHEAD and at < len(self.leaves):
                behind, at = behind + self.leaves[at].text[:AHEAD], at + 1
            found, left = [], len(text)
            for p in self.counter.split(text + behind[:AHEAD]) if text else ():
                if left <= 0:
                    break
                found.append(p)
                left -= len(p)
            leaf.pieces = found
        return leaf.pieces

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` (the last one beyond the end), and its first character."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if at - before < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                before, node = before + left, 2 * node + 1
        return node - self.width, before

    def _change(self, k: int, pieces: list[str], out: list[str], into: list[str]) -> None:
        """Leaf ``k`` has ``pieces`` from now on: ``out`` went and ``into`` came."""
        change = np.array([sum(map(len, into)) - sum(map(len, out)), sum([self.counter[p] for p in into]) - sum([self.counter[p] for p in out]), len(into) - len(out)])
        leaf, node = self.leaves[k], self.width + k
        leaf.pieces, leaf.counts = pieces, leaf.counts + change
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` up to ``end``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        first, at = self.find(max(0, start - CONTEXT))
        inside = 0  # pre-tokens of the first leaf that stay before
        for p in self.pieces(first):
            if at + len(p) > start - CONTEXT:
                break
            at, inside = at + len(p), inside + 1
        old, old_end, last, used = [], at, first, inside

        def take() -> bool:
            """One more old pre-token; false at the end of the text."""
            nonlocal old_end, last, used
            while used == len(self.pieces(last)):
                if last + 1 == len(self.leaves):
                    return False
                last, used = last + 1, 0
            old.append(self.pieces(last)[used])
            old_end, used = old_end + len(old[-1]), used + 1
            return True

        while old_end < end and take():
            pass
        shift, ahead = len(replacement) - (end - start), 4
        while True:
            for _ in range(ahead):
                more = take()
            text = "".join(old)
            text = text[: start - at] + replacement + text[end - at :]
            new, where = self.counter.split(text), at
            borders, x = set(), at
            for p in old:
                x += len(p)
                borders.add(x + shift)
            kept = None
            for k, p in enumerate(new):
                where += len(p)
                # a border that both have, behind the edit, and decided by what was taken
                if where in borders and where >= start + len(replacement) and (where + AHEAD <= at + len(text) or not more):
                    kept = k + 1
                    break
            if kept is not None or not more:
                break
            ahead *= 2
        new = new[:kept] if kept is not None else new
        end_of_new = at + sum(map(len, new)) - shift
        gone, x = 0, at  # old pre-tokens up to the border where both meet
        for p in old:
            x += len(p)
            gone += x <= end_of_new
        self.encoded += len(new) + gone
        self._replace(first, inside, gone, new)

    def _replace(self, first: int, inside: int, gone: int, new: list[str]) -> None:
        """``new`` for ``gone`` pre-tokens from the one ``inside`` leaf ``first`` on."""
        k, offset = first, inside
        while gone or k == first:
            pieces = self.pieces(k)
            out = pieces[offset : offset + gone]
            into = new if k == first else []
            self._change(k, pieces[:offset] + into + pieces[offset + len(out) :], out, into)
            gone, k, offset = gone - len(out), k + 1, 0
        grown = self.leaves[first].pieces
        if len(grown) > 2 * LEAF:
            self.encoded += len(grown)
            parts = [self._leaf(grown[at : at + LEAF], self.counter) for at in range(0, len(grown), LEAF)]
            self._plant([leaf for leaf in [*self.leaves[:first], *parts, *self.leaves[first + 1 :]] if leaf.counts[2]])


def _leaf_arrays(trees: list[TokenTree]) -> pa.ListArray:
    leaves = [leaf for tree in trees for leaf in tree.leaves if leaf.counts[2]]
    cuts = np.concatenate([[0], np.cumsum([sum(1 for leaf in tree.leaves if leaf.counts[2]) for tree in trees])])
    counts = np.array([leaf.counts for leaf in leaves], np.int32).reshape(-1, 3)
    columns = [pa.array([leaf.text for leaf in leaves], pa.string()), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(3))]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, ["text", "n_chars", "n_tokens", "n_pretokens"]))


def build_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_chars, n_tokens, n_pretokens, leaves of every row: a narrow map."""

    def run(batches):
        counter = PieceCounter(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                trees = [TokenTree.of_text(t or "", counter) for t in part.column(1).to_pylist()]
                sums = np.array([tree.sums[1] for tree in trees], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(3)), _leaf_arrays(trees)], names=[id_col, "n_chars", "n_tokens", "n_pretokens", "leaves"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{field(df, id_col)}, n_chars long, n_tokens long, n_pretokens long, leaves {LEAVES}")


def _stored_tree(leaves: pa.StructArray, counter: PieceCounter) -> TokenTree:
    """A tree over a stored column; texts stay in the column until touched."""
    texts = leaves.field("text")
    counts = np.stack([leaves.field(k).to_numpy(zero_copy_only=False) for k in ("n_chars", "n_tokens", "n_pretokens")], axis=1).astype(np.int64)
    return TokenTree([Leaf(lambda k=k: texts[k].as_py(), c) for k, c in enumerate(counts)], counter)


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", order_col: str = "seq") -> DataFrame:
    """``trees`` with a column ``edits`` from a table of (id, order, start, end, replacement)."""
    lists = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("seq"), "start", "end", "replacement"))).alias("edits"))
    return trees.join(lists.withColumn("edits", F.transform("edits", lambda e: F.struct(e.start.alias("start"), e.end.alias("end"), e.replacement.alias("replacement")))), id_col, "left")


def apply_edits(trees: DataFrame, id_col: str = "doc_id", edits_col: str = "edits", vocabulary: str | None = None, keep_trees: bool = True) -> DataFrame:
    """id, n_pretokens and n_tokens before, n_chars_edited, n_tokens_edited,
    n_reencoded (pre-tokens that the edits made it encode), and the leaves after
    the edits (null unless ``keep_trees``).
    """
    out = T.StructType.fromDDL(f"{field(trees, id_col)}, n_pretokens long, n_tokens long, n_chars_edited long, n_tokens_edited long, n_reencoded long, leaves {LEAVES}")

    def run(batches):
        counter, schema = PieceCounter(vocabulary), to_arrow_schema(out)
        for batch in batches:
            rows, done = [], []
            # the slices of a list array are views; leaf texts stay unread
            for leaves, edits in zip(batch.column(1), batch.column(2).to_pylist()):
                tree = _stored_tree(leaves.values if leaves.is_valid else batch.column(1).values[:0], counter)
                before = tree.n_pieces, tree.n_tokens
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                rows.append((*before, tree.n_chars, tree.n_tokens, tree.encoded))
                if keep_trees:
                    done.append(tree)
            counts = np.array(rows, np.int64).reshape(-1, 5)
            kept = _leaf_arrays(done) if keep_trees else pa.nulls(len(rows), schema.field(6).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(5)), kept.cast(schema.field(6).type)], schema=schema)

    return trees.select(F.col(id_col), "leaves", F.col(edits_col).cast(EDITS)).mapInArrow(run, out)


def op9(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, and again after three edits of each: a note put
    in its middle, its first ten characters cut, its last word replaced.  The edits
    go to stored trees."""
    trees = written(build_trees(docs))
    n = F.col("n_chars")
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("replacement"))
    middle = F.floor(n / 2)
    edits = F.array(edit(middle, middle, " [edited here] "), edit(F.lit(0), F.lit(10), ""), edit(n - 3, n + 40, "the end."))
    return apply_edits(trees.withColumn("edits", edits), keep_trees=False).drop("leaves")
