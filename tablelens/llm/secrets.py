"""Secret scans: known shapes, and random strings found by token efficiency.

A random string costs many tokens for its length: natural words and identifiers
reach three to five characters per token of a byte-pair vocabulary, random ones
stay below two.  Candidates are runs of key characters outside the spans that
the known shapes give (what is left of a run that they touch is tested alone), of
``SHORTEST`` characters or more: base spans of values begin at 12 and 16, and under
16 the ratio of names and of random strings overlap.  Digests of the right length
and identifiers are left out.  Letters in one case are a name only if they are few
or read like words, that is, cost few tokens; long rare words and random letters look
alike under 20.

Lower-case digests of 16 digits or more are spans all the same, of kind ``hex``, and
``redact_secrets`` masks them with the others.

Defined cases: a null text counts as empty and gives no span; an empty text
gives none; a very long text is scanned whole, in time proportional to it; a span is
measured in code points, end exclusive; spans that start together come in the order
of their kinds; repeated rows give repeated results; an empty table gives an empty
one; other columns, whatever their names, pass through or are not read.
"""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, slices

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Bytes of the digests of known algorithms.
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}

#: Fewer characters per token than this mark a random string.
MAX_CHARS_PER_TOKEN = 2.2
#: Candidates need at least so many distinct characters: a row of dashes or a
#: repeated word is no secret.
MIN_DISTINCT = 10
#: A part of so few letters in one case is a name at any cost in tokens; a whole run
#: of letters in one case is one under ``LONG_PART``, which is also the length from
#: which a part that is no name is tested apart from its run.
SHORT_NAME, LONG_PART = 8, 20


def digest_pattern() -> str:
    """Digests behind the name of their algorithm, hexadecimal or in base 64, or in
    hexadecimal alone; each of its algorithm's length."""
    named = [rf"{name}[-_=/]?(?:[0-9a-f]{{{2 * n}}}|[A-Za-z0-9+/]{{{-(-8 * n // 6)}}}={{0,{-n % 3}}})" for name, n in DIGEST_BYTES.items()]
    return "|".join(named + [rf"[0-9a-f]{{{2 * n}}}" for n in DIGEST_BYTES.values()])


DIGEST = re.compile(digest_pattern(), re.IGNORECASE)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The tiktoken encoding of a rank file; one per Python process."""
    import public_tokenizers
    import tiktoken

    with open(path or tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three known shapes, ordered by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def chars_per_token(run: str, enc) -> float:
    return len(run) / len(enc.encode_ordinary(run))


def parts_of(run: str) -> list[str]:
    return [p for p in re.split(r"[+/_=-]+", run) if p]


def one_case(part: str) -> bool:
    """Letters in lower case, capitalised or in upper case."""
    return part.isalpha() and (part[1:].islower() or part.isupper() or len(part) < 3)


def wordlike(part: str, enc, max_ratio: float) -> bool:
    """Letters in one case, few or of ordinary cost."""
    return one_case(part) and (len(part) < SHORT_NAME or max(chars_per_token(part, enc), chars_per_token(part.lower(), enc)) >= max_ratio)


def known_identifier(run: str, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Digests, UUIDs, plain numbers, and names or paths made of words."""
    if UUID.fullmatch(run) or DIGEST.fullmatch(run) or not re.search(r"[A-Za-z]", run):
        return True
    if len(run) < LONG_PART and one_case(run):
        return True
    return all(wordlike(p, enc, max_ratio) for p in parts_of(run))


def is_random(run: str, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether the vocabulary compresses a run, or a long part of it, badly."""
    if len(set(run)) < MIN_DISTINCT or known_identifier(run, enc, max_ratio):
        return False
    if chars_per_token(run, enc) < max_ratio:
        return True
    long = (p for p in parts_of(run) if LONG_PART <= len(p) < len(run) and len(set(p)) >= MIN_DISTINCT)
    return any(not known_identifier(p, enc, max_ratio) and chars_per_token(p, enc) < max_ratio for p in long)


def outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the spans in ``taken``, ordered by start, leave of a range."""
    out = []
    for s, e, _ in taken:
        if s < end and start < e:
            if start < s:
                out.append((start, s))
            start = e
    return out + [(start, end)] if start < end else out


def random_spans(text: str, taken: list[tuple[int, int, str]], enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """Runs, or what the spans in ``taken`` leave of them, that the vocabulary compresses badly."""
    out = []
    for m in CANDIDATE.finditer(text):
        if len(set(m.group())) >= MIN_DISTINCT and not known_identifier(m.group(), enc, max_ratio):
            out += [(s, e, "random") for s, e in outside(m.start(), m.end(), taken) if is_random(text[s:e], enc, max_ratio)]
    return out


def find_spans(text: str | None, enc, max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    text = text or ""
    base = base_spans(text)
    extra = random_spans(text, base, enc, max_ratio)
    return sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]))) if extra else base


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """``text`` with every span, or run of overlapping spans, as one ``mask``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """id, spans (array of start, end, kind): a narrow map, no shuffle."""

    def make():
        enc = encoding(vocabulary)
        return lambda ids, texts: [(i, [{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t, enc, max_ratio)]) for i, t in zip(ids, texts)]

    return map_texts(df, make, f"{field(df, id_col)}, spans array<struct<start:int,end:int,kind:string>>", id_col, text_col)


def redact_secrets(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The same rows and columns; secrets in the text are masked.

    A null text stays null.  Other columns pass through unread by Python.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out, at = df.schema, df.columns.index(text_col)

    def run(batches):
        enc = encoding(vocabulary)
        schema = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, at):
                texts = [t and redact(t, find_spans(t, enc, max_ratio)) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(texts, type=schema.field(at).type)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, out)


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result columns of query op2, derived from ``scan_secrets``."""
    spans = scan_secrets(df, id_col, text_col)
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return spans.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda x: x.kind != "random")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        count("random").alias("n_random"),
    )
