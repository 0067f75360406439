"""The compiled automaton, and encoding and decoding of columns."""

import json
import random

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import bpe, secrets  # noqa: E402

PATH = secrets.tokenizer_file("word_bpe_49k.json")
ROWS = [(1, "Hello, World! 12"), (1, "Hello, World! 12"), (2, None), (3, ""), (None, "ein schönes <|endoftext|> Ding"), (4, "x" * 3000)]


def test_rows_of_the_table_say_what_the_gadgets_say():
    """A state's ranges against a full construction of the automaton, arc by arc."""
    rng = random.Random(5)
    for _ in range(40):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 18)):
            m = (rng.choice(tokens), rng.choice(tokens))
            if m[0] + m[1] not in tokens:
                merges.append(m)
                tokens.append(m[0] + m[1])
        vocab = {t: k for k, t in enumerate(tokens)}
        machine = bpe.TokenizationAutomaton(vocab, merges)
        # arcs[t]: labels that the state after t has; None is the start
        arcs: dict = {t: set("abc") for t in [None, *"abc"]}
        for u, v in merges:
            if u not in arcs or v not in arcs or v not in arcs[u]:
                continue
            arcs[u + v] = set(arcs[v])
            arcs[u].discard(v)
            for labels in arcs.values():
                if u in labels:
                    labels.add(u + v)
        for t, labels in arcs.items():
            if t is not None:
                assert {w for w in arcs if w is not None and machine.allowed(vocab[t], vocab[w])} == labels, (merges, t)


def test_states_lack_few_ranges():
    machine = bpe.WordBpe(PATH).automaton
    sizes = [len(machine.row(t)) // 2 for t in list(machine.number)[::7]]
    assert sum(sizes) / len(sizes) < 40  # |V| = 49,406 labels


def test_ids_decode_from_a_column(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    packed = bpe.encode_documents(docs)
    lists = bpe.encode_texts(docs)
    want = sorted((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in ROWS if i is not None)
    for ids in (packed, lists):
        got = [(r.doc_id, r.decoded) for r in bpe.decode_ids(ids).collect()]
        assert len(got) == len(ROWS) and sorted(x for x in got if x[0] is not None) == want
        assert bpe.decode_ids(ids.filter("false")).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 10**7, -1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode_ids(odd).collect()} == {1: None, 2: "", 3: library.decode([320], skip_special_tokens=False)}
    assert bpe.encode_documents(docs.filter("false")).collect() == []


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="isn't supported"):
        bpe.load_tokenizer(str(tmp_path / "t.json"))
    # another pattern is followed, not replaced
    spec["pre_tokenizer"]["pretokenizers"][0] |= {"behavior": "Removed", "pattern": {"Regex": "[a-z]+"}}
    (tmp_path / "u.json").write_text(json.dumps(spec))
    own = bpe.WordBpe(str(tmp_path / "u.json"))
    from tokenizers import Tokenizer

    for t in ("abc 123 def!", "a1b2", "Zebra-crossing 7"):
        assert bpe.unpack(own.encode(t)).tolist() == Tokenizer.from_file(str(tmp_path / "u.json")).encode(t, add_special_tokens=False).ids
