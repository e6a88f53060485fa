"""GIF code streams against a plain bit-by-bit reader, and files that state more than they hold."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgetide.llm import gif


def plain_lzw(data: bytes, width: int) -> bytes:
    """A reader that takes one bit after the other."""
    bits = [b >> k & 1 for b in data for k in range(8)]
    clear, at, out, size = 1 << width, 0, [], width + 1
    table, last = {}, None
    while at + size <= len(bits):
        code = sum(bits[at + k] << k for k in range(size))
        at += size
        if code == clear:
            table, last, size = {i: (i,) for i in range(clear)}, None, width + 1
            continue
        if code == clear + 1:
            break
        word = table.get(code) or last + last[:1]
        out += word
        free = clear + 2 + len(table) - clear
        if last and free < 4096:
            table[free] = last + word[:1]
            if free + 1 == 1 << size and size < 12:
                size += 1
        last = word
    return bytes(out)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 8), st.lists(st.integers(0, 255), max_size=300))
def test_streams_by_hypothesis(width, values):
    samples = bytes(v % (1 << width) for v in values)
    stream = gif.lzw_encode(samples, width)
    assert plain_lzw(stream, width) == samples == gif.lzw_decode(stream, width, len(samples)).tobytes()


@pytest.mark.parametrize("width", [2, 5, 8])
@pytest.mark.parametrize("shape", ["random", "one value", "periodic"])
def test_full_tables(width, shape):
    """Streams long enough to fill the table and to be cleared."""
    rnd = random.Random(width)
    value = {"random": lambda i: rnd.randrange(1 << width), "one value": lambda i: 1, "periodic": lambda i: (i * i >> 4) % (1 << width)}[shape]
    samples = bytes(value(i) for i in range(20_000))
    stream = gif.lzw_encode(samples, width)
    assert plain_lzw(stream, width) == samples == gif.lzw_decode(stream, width, len(samples)).tobytes()


def test_a_table_that_is_never_cleared():
    """A writer may leave a full table as it is: widths stay at 12 bits."""
    rnd = random.Random(8)
    samples = [rnd.randrange(4) for _ in range(60_000)]
    table, codes, prefix = {(i,): i for i in range(4)}, [4], ()
    for s in samples:
        if (*prefix, s) in table:
            prefix = (*prefix, s)
            continue
        codes.append(table[prefix])
        if len(table) + 2 < 4096:
            table[*prefix, s] = len(table) + 2
        prefix = (s,)
    codes += [table[prefix], 5]
    widths = np.concatenate([[3], gif.schedule(2, len(codes) - 1)])
    stream = gif.pack_bits(np.array(codes, dtype=np.uint64), widths)
    assert gif.lzw_decode(stream, 2, len(samples)).tobytes() == bytes(samples) == plain_lzw(stream, 2)


def test_stated_sizes_are_bounded(spark):
    """Files that state a huge frame, many large ones or a huge canvas give their error, not memory."""
    screen = lambda w, h: b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + bytes(6)
    image = lambda w, h: b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x02" + gif.sub_blocks(gif.lzw_encode(b"\1", 2))
    made = [screen(2, 2) + image(65535, 65535) + b"\x3b", screen(2, 2) + image(8000, 8000) * 40 + b"\x3b", screen(65535, 65535) + image(1, 1) + b"\x3b", screen(2, 2) + image(2, 2) + b"\x3b"]
    rows = gif.frames(spark.createDataFrame(list(enumerate(made)), "doc_id long, gif binary")).collect()
    assert sorted(r.doc_id for r in rows if r.error) == [0, 1, 2] and sorted(r.doc_id for r in rows if not r.error) == [3]


def test_interlaced_local_palette():
    """Rows of an interlaced frame are put in order, and a local palette counts before the shared one."""
    samples = np.repeat(np.arange(16, dtype=np.uint8) % 4, 3).reshape(16, 3)
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    local = bytes([9, 9, 9, 80, 0, 0, 0, 80, 0, 0, 0, 80])
    data = b"GIF87a" + struct.pack("<HHBBB", 3, 16, 0x80, 0, 0) + bytes(6)
    data += b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 16, 0xC1) + local + b"\x02" + gif.sub_blocks(gif.lzw_encode(samples[order].tobytes(), 2)) + b"\x3b"
    made = gif.decode(data)
    assert (made.frames[0].samples == samples).all()
    assert gif.render(made)[0][5, 0].tolist() == [80, 0, 0, 255]
