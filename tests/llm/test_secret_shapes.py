"""Short random keys, digests of the right length, and common names."""

import hashlib
import random
import string

import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import secrets  # noqa: E402


def kinds(text):
    return [k for _, _, k in secrets.find_spans(text, secrets.encoding())]


@pytest.mark.parametrize("size", [16, 19, 20, 32])
def test_random_keys_of_any_size_from_the_floor(size):
    rng = random.Random(size)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=size)) for _ in range(300)]
    assert sum(kinds(f"the {k} end") == ["random"] for k in keys) >= 0.97 * len(keys)


def test_digests_are_left_out_at_their_length_only():
    rng = random.Random(1)
    for name in secrets.DIGEST_BYTES:
        d = hashlib.new(name, rng.randbytes(9)).hexdigest().upper()
        assert kinds(f"see {d} here") == [] and kinds(f"see {name}-{d} here") == []
        assert kinds(f"see {name}_{d}{'Zq8vX2kL'} here") != []
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=25))
    for name in ("md5", "sha1", "sha256"):
        assert kinds(f"see {name}{key} here") == ["random"]


@pytest.mark.parametrize("name", ["getElementsByTagName", "HttpServletRequest", "max_shuffle_partitions", "2024-01-01_2024-12-31", "user/local/share/doc", "understandability", "README_CONTRIBUTING", "https://example/index-of-pages", "----------------------", "98765-43210-98765-43210", "erkeitpfenchachst"])
def test_names_are_no_secrets(name):
    assert kinds(f"see {name} here") == []
