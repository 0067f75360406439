"""Random strings of letters in one case, and beside known shapes."""

import random
import string

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import secrets  # noqa: E402


def spans(text):
    return secrets.find_spans(text, secrets.encoding())


@pytest.mark.parametrize("form", [str.lower, str.upper, str.capitalize])
@pytest.mark.parametrize("size", [24, 64])
def test_letters_in_one_case_are_tested(form, size):
    rng = random.Random(size)
    for _ in range(50):
        key = form("".join(rng.choices(string.ascii_lowercase, k=size)))
        assert spans(f"a {key} b") == [(2, 2 + size, "random")], key
        run = f"configuration_management_{key}"
        assert spans(run) == [(0, len(run), "random")], key
    assert spans("kqzvxjwprtblmnhgfdsyqzxk") == [(0, 24, "random")]


@pytest.mark.parametrize("name", ["internationalization", "INTERNATIONALIZATION_OF_CONFIGURATION", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "usr/share/documentation/README", "max_len_cfg_idx_ptr_tmp_buf"])
def test_words_are_no_secrets(name):
    assert spans(f"see {name} here") == []


def test_rest_of_a_run_beside_known_shapes():
    key = "0123456789abcdef0Qz8vX2kLw9RtYpB4mNc"
    assert spans(f"k {key} e") == [(2, 19, "hex"), (19, 2 + len(key), "random")]
    assert secrets.redact(f"k {key} e", spans(f"k {key} e")).count("B4mNc") == 0
    turned = "Qz8vX2kLw9RtYpB4mNc0123456789abcdef0"
    assert [k for _, _, k in spans(turned)] == ["random", "hex"]
    assert [k for _, _, k in spans("my_configuration_password=qZ8vX2kLw9RtYpB4")] == ["assign"]
    assert spans("sha256-" + "0123456789abcdef" * 4) == [(7, 71, "hex")]
