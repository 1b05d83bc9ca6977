"""Block codecs: round trips and damaged input."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lucidframe.codecs import blocks, huffman, piz, wavelet

DATA = st.one_of(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=12).map(lambda runs: b"".join(bytes([b]) * n for b, n in runs)))


@settings(max_examples=150, deadline=None)
@given(DATA)
def test_blocks(data):
    assert blocks.rle_unpack(blocks.rle_pack(data), len(data)) == data
    if data:
        assert blocks.gather(blocks.scatter(data)) == data
        assert blocks.rle_decode(blocks.rle_encode(data), len(data)) == data
        assert blocks.zip_decode(blocks.zip_encode(data), len(data)) == data
        assert len(blocks.zip_encode(data)) <= len(data)


def test_runs():
    assert blocks.rle_pack(b"aaaab") == bytes([3]) + b"a" + bytes([255]) + b"b"
    assert blocks.rle_pack(b"ab") == bytes([254]) + b"ab"


def test_damage():
    for bad in (b"\x05", b"\x05a\x80", b"\xf0abc"):
        with pytest.raises(blocks.CorruptBlock):
            blocks.rle_unpack(bad, 4)
    with pytest.raises(blocks.CorruptBlock):
        blocks.zip_decode(b"xyz", 10)
    with pytest.raises(blocks.CorruptBlock):
        huffman.decode(b"\0" * 30, 5)


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (3, 5), (32, 17), (7, 64), (1, 9), (33, 31)])
@pytest.mark.parametrize("largest", [5, 1 << 13, 65535])
def test_wavelet(shape, largest):
    v = np.random.default_rng(1).integers(0, largest + 1, shape).astype(np.uint16)
    assert (wavelet.decode(wavelet.encode(v, largest), largest) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 65535), st.integers(1, 700)), min_size=1, max_size=30))
def test_huffman(runs):
    s = np.concatenate([np.full(n, v, np.uint16) for v, n in runs])
    assert (huffman.decode(huffman.encode(s), len(s)) == s).all()


def test_long_codes():
    s = np.concatenate([np.full(int(1.6**k) + 1, k) for k in range(26)]).astype(np.uint16)
    np.random.default_rng(2).shuffle(s)
    assert (huffman.decode(huffman.encode(s), len(s)) == s).all()


@pytest.mark.parametrize(("lines", "width", "sizes"), [(32, 20, [1, 1, 2]), (5, 7, [2]), (32, 64, [1, 1, 1, 1]), (1, 1, [1])])
@pytest.mark.parametrize("kind", ["zeros", "smooth", "noise"])
def test_piz(lines, width, sizes, kind):
    r = np.random.default_rng(3)
    n = lines * width * sum(sizes)
    words = {"zeros": np.zeros(n), "smooth": np.cumsum(r.integers(-3, 4, n)) + 2000, "noise": r.integers(0, 65536, n)}[kind].astype("<u2")
    data = words.tobytes()
    assert piz.decode(piz.encode(data, lines, width, sizes), len(data), lines, width, sizes) == data


# blocks written by hand, from the format's rules ------------------------------------------------------------------------


def test_huffman_block_by_hand():
    """3 has the code 1, 4 has 00 and the run symbol 5 has 01; lengths 1, 2, 2 in six bits each, then 1 1 1 00."""
    block = struct.pack("<5i", 3, 5, 3, 5, 0) + b"\x04\x20\x80" + b"\xe0"
    assert huffman.encode(np.array([3, 3, 3, 4], np.uint16)) == block
    assert huffman.decode(block, 4).tolist() == [3, 3, 3, 4]
    runs = struct.pack("<5i", 3, 5, 3, 1 + 2 + 8 + 2, 0) + b"\x04\x20\x80" + bytes([0b10100000, 0b10100000])  # 3, run of 5 more, 4
    assert huffman.decode(runs, 7).tolist() == [3] * 6 + [4]
    # lengths of 3, seven unused symbols, 11 and 12: 000001 111111 00000001 000010 000001
    assert huffman.unpack_lengths(bytes([0b00000111, 0b11110000, 0b00010000, 0b10000001]), 3, 12) == {3: 1, 11: 2, 12: 1}


def test_zip_and_run_blocks_by_hand():
    """1 2 3 4: even bytes 1 3, odd bytes 2 4; differences of neighbours moved by 128."""
    assert blocks.scatter(bytes([1, 2, 3, 4])).tolist() == [1, 130, 127, 130]
    assert blocks.zip_decode(zlib.compress(bytes([1, 130, 127, 130])), 4) == bytes([1, 2, 3, 4])
    assert blocks.rle_decode(bytes([0xFF, 1, 6, 128]), 8) == bytes([1] * 8)  # one byte as it is, then seven steps of zero


def test_wavelet_block_by_hand():
    """Four ones: bitmap byte 2, one average and three zero differences, coded as 00 1 1 1."""
    coded = struct.pack("<5i", 0, 2, 3, 5, 0) + b"\x04\x20\x80" + b"\x38"
    block = struct.pack("<HH", 0, 0) + b"\x02" + struct.pack("<i", len(coded)) + coded
    assert np.frombuffer(piz.decode(block, 8, 2, 2, [1]), "<u2").tolist() == [1, 1, 1, 1]
    assert wavelet.encode(np.ones((2, 2), np.uint16), 1).tolist() == [[1, 0], [0, 0]]


def test_many_bits():
    """More data than one stretch, long codes, and runs across its end."""
    r = np.random.default_rng(4)
    s = np.repeat(np.minimum(r.geometric(0.002, 60_000), 65_535), r.choice([1, 1, 1, 40, 700], 60_000, p=[0.4, 0.3, 0.27, 0.02, 0.01])).astype(np.uint16)
    assert (huffman.decode(huffman.encode(s), len(s)) == s).all()
