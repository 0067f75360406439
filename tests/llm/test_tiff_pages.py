"""TIFF pages one by one, against bytes written by hand."""

import struct
import zlib

import numpy as np
import pytest

pytest.importorskip("tablelens.llm")

from tablelens.llm import media  # noqa: E402


def tiff(directories, order="<"):
    """A file from (tags, strips) pairs: strips behind the header, then directories."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for tags, strips in directories:
        at = []
        for s in strips:
            at.append(len(out))
            out += s
        tags = {273: at, 279: [len(s) for s in strips]} | tags
        entries = b""
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + raw
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def grey(width, height, bits=8, **more):
    return {256: [width], 257: [height], 258: [bits], 259: [1], 262: [1], 277: [1], 278: [height]} | {int(k[1:]): v for k, v in more.items()}


def codes(*values):
    """9-bit codes, high bit first."""
    bits = "".join(f"{v:09b}" for v in values)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_packbits_example_of_its_note():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


def test_lzw_example_of_the_specification():
    # 7 7 7 8 8 7 7 6 6 is written as clear, 7, 258, 8, 8, 258, 6, 6, end
    assert media.lzw_decode(codes(256, 7, 258, 8, 8, 258, 6, 6, 257)) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    with pytest.raises(ValueError):
        media.lzw_decode(codes(256, 7, 400, 257))


def test_either_byte_order_and_every_depth():
    for order in "<>":
        (page,) = media.read_pages(tiff([(grey(3, 2), [bytes([1, 2, 3, 4, 5, 6])])], order))
        assert page[..., 0].tolist() == [[1, 2, 3], [4, 5, 6]]
        deep = struct.pack(order + "4H", 1, 500, 2, 65535)
        (page,) = media.read_pages(tiff([(grey(2, 2, 16), [deep])], order))
        assert page[..., 0].tolist() == [[1, 500], [2, 65535]]
        steps = struct.pack(order + "4H", 7, 1, 65535, 2)
        (page,) = media.read_pages(tiff([(grey(2, 2, 16, t317=[2]), [steps])], order))
        assert page[..., 0].tolist() == [[7, 8], [65535, 1]]
    (page,) = media.read_pages(tiff([(grey(10, 2, 1), [bytes([0b10110000, 0b01000000, 0b00000001, 0b11000000])])]))
    assert page[..., 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 0, 0, 1], [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]]
    (page,) = media.read_pages(tiff([(grey(3, 1, 4), [bytes([0x1F, 0xA0])])]))
    assert page[..., 0].tolist() == [[1, 15, 10]]
    (page,) = media.read_pages(tiff([(grey(8, 1, 1, t266=[2]), [bytes([0b00000001])])]))
    assert page[..., 0].tolist() == [[1, 0, 0, 0, 0, 0, 0, 0]]


def test_planes_and_strips():
    planes = [bytes([1, 2]), bytes([3, 4]), bytes([5, 6]), bytes([7, 8])]  # two strips of each of two planes
    tags = grey(2, 2, 8) | {258: [8, 8], 277: [2], 278: [1], 284: [2]}
    (page,) = media.read_pages(tiff([(tags, planes)]))
    assert page[..., 0].tolist() == [[1, 2], [3, 4]] and page[..., 1].tolist() == [[5, 6], [7, 8]]


def test_bad_pages_leave_the_others(spark):
    good, bad = (grey(2, 1), [b"ab"]), (grey(2, 1) | {259: [99]}, [b"ab"])
    short = (grey(9, 9), [b"ab"])
    bomb = (grey(1, 1) | {259: [8]}, [zlib.compress(b"x" * 10_000_000)])
    huge = (grey(1 << 20, 1 << 20), [b"ab"])
    looped = bytearray(tiff([good, good]))
    looped[-4:] = struct.pack("<I", struct.unpack_from("<I", looped, 4)[0])
    lost = bytearray(tiff([good, good]))
    lost[-4:] = struct.pack("<I", 1 << 30)
    files = {1: tiff([good, bad, good, short, huge, bomb]), 2: bytes(looped), 3: bytes(lost), 4: b"", 5: None, 6: b"II*\0\xff\xff\xff\xff"}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "id long, data binary")
    got = {}
    for r in media.explode_pages(df, "id", "data").orderBy("id", "page").collect():
        got.setdefault(r.id, []).append(bytes(r.pixels) if r.error is None else "error")
    assert got == {1: [b"ab", "error", b"ab", "error", "error", b"x"], 2: [b"ab", b"ab", "error"], 3: [b"ab", b"ab", "error"], 4: ["error"], 5: ["error"], 6: ["error"]}
