"""GIF media: code streams, palettes, disposal and transparency, timed frames with colour histograms.

`decode` reads any GIF of the 87a and 89a kinds: LZW code streams with growing
code widths, global and local palettes, interlacing, transparency, delays and
disposal; `shown` composes its frames, and what rows tell of a frame is of the
canvas as shown. `encode` writes 8-bit samples as a timed grey animation, on
request by the compressing encoder, as the operator does. Without it, the code
table is cleared before the width grows. Bits are packed and cut as arrays; the
code table itself is worked code by code.

Defined cases: a null or empty text is a payload of 64 zero bytes; long texts
span several frames; a broken file, or one that states a canvas or a frame of
more than 2^26 samples, or leaves more than that unsaid, gives no frames and its
error; repeated rows give equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import map_texts
from edgetide.session import bound_arrow, ship

WIDTH = 64
FRAME_ROWS = 1024
#: A clear code and 247 samples are 248 codes of 9 bits: whole bytes, and short enough for the width to stay at 9.
RUN = 247
#: A canvas beyond this many samples (256 MB) gives an error, not a row's value.
MOST = 1 << 26
GREY = bytes(v for v in range(256) for _ in range(3))


@dataclass
class Frame:
    """One image of a GIF as stored."""

    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


@dataclass
class Gif:
    """A decoded file."""

    width: int
    height: int
    background: np.ndarray | None
    frames: list[Frame]


def sub_blocks(data: bytes) -> bytes:
    """Data in blocks of at most 255 bytes, with their lengths, then the end."""
    whole = len(data) // 255
    body = np.empty((whole, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def lzw_literals(samples: np.ndarray) -> bytes:
    """An 8-bit code stream of clear codes and literals only."""
    whole = len(samples) // RUN
    codes = np.empty((whole, RUN + 1), dtype=np.uint16)
    codes[:, 0] = 256
    codes[:, 1:] = samples[: whole * RUN].reshape(whole, RUN)
    rest = samples[whole * RUN :]
    every = np.concatenate([codes.reshape(-1), [256], rest, [257]]).astype(np.uint64)
    return pack_bits(every, np.full(len(every), 9))


def schedule(width: int, n: int) -> np.ndarray:
    """The bit widths of the first `n` codes after a clear: wider once the table has filled a power of two, 12 at most."""
    free = (1 << width) + 2 + np.maximum(np.arange(n) - 1, 0)  # codes known when the k-th is read
    return np.clip(np.frexp(free.astype(np.float64))[1], width + 1, 12)


def lzw_encode(samples: bytes, width: int = 8) -> bytes:
    """The compressing encoder, with a table that grows to 4096 codes and is then cleared. The bits are packed as arrays."""
    clear = 1 << width
    codes: list[int] = [clear]
    lengths: list[int] = []  # codes of each table, its clear not among them
    put, table, free, begun, prefix = codes.append, {}, clear + 2, 1, -1
    known = table.get
    for s in samples:
        if prefix < 0:
            prefix = s
            continue
        key = prefix << 8 | s
        code = known(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = s
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(clear)
            lengths.append(len(codes) - begun)
            begun, free = len(codes), clear + 2
            table.clear()
    if prefix >= 0:
        put(prefix)
    put(clear + 1)
    lengths.append(len(codes) - begun)
    widths = schedule(width, max(lengths))
    return pack_bits(np.array(codes, dtype=np.uint64), np.concatenate([[width + 1], *(widths[:n] for n in lengths)]))


def pack_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits, least significant bit first."""
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros((int(ends[-1]) >> 3) + 4, dtype=np.uint8)
    moved = codes << (starts & 7).astype(np.uint64)  # within 19 bits, so within three bytes
    at = starts >> 3
    for k in range(3):  # codes are at least 3 bits wide, so those that share a byte add up without carries
        out += np.bincount(at + k, weights=(moved >> np.uint64(8 * k)) & np.uint64(255), minlength=len(out)).astype(np.uint8)[: len(out)]
    return out[: (int(ends[-1]) + 7) >> 3].tobytes()


def read_codes(data: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths from a bit on. `data` ends in four bytes of zeros."""
    starts = bit + np.cumsum(widths) - widths
    at = starts >> 3
    word = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << 8 | data[at + 2].astype(np.uint32) << 16
    return (word >> (starts & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(data: bytes, width: int, wanted: int) -> np.ndarray:
    """The samples of a code stream, at most `wanted` of them.

    Codes are cut from the bits as arrays, up to the next clear; the table then
    decodes them. A stream that never clears is read in portions of 12 bits.
    """
    clear, end = 1 << width, (1 << width) + 1
    padded = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8)
    total, bit = 8 * len(data), 0
    # The table takes 4096 - clear entries; then widths stay.
    first = schedule(width, 4096 - clear + 1)
    steady = np.full(1 << 12, 12)
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    parts: list[bytes] = []
    have, table, prev, fresh = 0, literals.copy(), b"", True
    while have < wanted:
        widths = first if fresh else steady
        fits = int(np.searchsorted(np.cumsum(widths), total - bit, side="right"))
        codes = read_codes(padded, bit, widths[:fits])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else len(codes)
        grown = len(table)
        add, keep = table.append, parts.append
        for code in codes[:used].tolist():
            if code < grown:
                entry = table[code]
            elif code == grown and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("a code beyond the table")
            keep(entry)
            if prev and grown < 4096:
                add(prev + entry[:1])
                grown += 1
            prev = entry
        done = b"".join(parts)
        have, parts = have + len(done), []
        out.append(done)
        if not len(stop):
            if fits < len(widths):
                break  # the data end here
            bit += int(widths.sum())
            fresh = False
        elif codes[used] == end:
            break
        else:
            bit += int(widths[: used + 1].sum())
            table, prev, fresh = literals.copy(), b"", True
    return np.frombuffer(b"".join(out)[:wanted], dtype=np.uint8)


def encode(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_ms: int = 40, compress: bool = False) -> bytes:
    """Samples, a multiple of `width` of them, as grey frames of at most `rows` rows each."""
    data = np.frombuffer(samples, dtype=np.uint8)
    height = min(rows, len(data) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for at in range(0, len(data), width * rows):
        frame = data[at : at + width * rows]
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_ms // 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0), b"\x08"]
        parts.append(sub_blocks(lzw_encode(frame.tobytes()) if compress else lzw_literals(frame)))
    return b"".join([*parts, b"\x3b"])


def read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from `at`, and the place after their end. Runs of full blocks are joined as an array."""
    parts = []
    while True:
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if n == 255:
            heads = np.frombuffer(data, dtype=np.uint8)[at::256]
            short = np.flatnonzero(heads != 255)
            full = int(short[0]) if len(short) else len(heads) - 1
            parts.append(np.frombuffer(data, dtype=np.uint8, count=full * 256, offset=at).reshape(full, 256)[:, 1:].tobytes())
            at += full * 256
        else:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n


def decode(data: bytes) -> Gif:
    """All frames of a file, with their palettes and timing."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).reshape(-1, 3)
        at += n
    gif = Gif(width, height, shared[back] if shared is not None and back < len(shared) else None, [])
    delay = disposal = missing = 0
    transparent: int | None = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                palette = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).reshape(-1, 3)
                at += n
            if palette is None:
                raise ValueError("no palette")
            if w * h > MOST:
                raise ValueError("too large a frame")
            if not 2 <= data[at] <= 8:
                raise ValueError("an impossible code width")
            body, after = read_blocks(data, at + 1)
            samples = lzw_decode(body, data[at], w * h)
            at = after
            if len(samples) < w * h:
                missing += w * h - len(samples)
                if missing > MOST:
                    raise ValueError("too many samples that the data don't hold")
                samples = np.concatenate([samples, np.zeros(w * h - len(samples), dtype=np.uint8)])
            samples = samples.reshape(h, w)
            if flags & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            gif.frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, samples))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError(f"an unknown block at {at}")
    return gif


def shown(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas, height x width x RGBA, as shown at each frame; to be read before the next one is asked for."""
    if gif.height * gif.width > MOST:
        raise ValueError("too large a canvas")
    canvas = np.zeros((gif.height, gif.width, 4), dtype=np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = f.samples[: area.shape[0], : area.shape[1]]
        drawn = samples < len(f.palette)
        if f.transparent is not None:
            drawn = drawn & (samples != f.transparent)
        area[drawn, :3] = f.palette[samples[drawn]]
        area[drawn, 3] = 255
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def render(gif: Gif) -> list[np.ndarray]:
    """All that `shown` gives, at once."""
    return [canvas.copy() for canvas in shown(gif)]


def canvas_histogram(canvas: np.ndarray, bits: int = 2) -> np.ndarray:
    """Counts of a canvas's visible samples by colour, `bits` of each channel."""
    flat = canvas.reshape(-1, 4)
    p = flat[flat[:, 3] > 0, :3] >> (8 - bits)
    return np.bincount((p[:, 0].astype(np.int64) << 2 * bits) | (p[:, 1].astype(np.int64) << bits) | p[:, 2], minlength=1 << 3 * bits)


def histogram(frame: Frame, bits: int = 2) -> np.ndarray:
    """Counts of a frame's visible samples by colour, `bits` of each channel."""
    counts = np.bincount(frame.samples.reshape(-1), minlength=256)[: len(frame.palette)].copy()
    if frame.transparent is not None and frame.transparent < len(counts):
        counts[frame.transparent] = 0
    p = frame.palette[: len(counts)].astype(np.int64) >> (8 - bits)
    return np.bincount((p[:, 0] << 2 * bits) | (p[:, 1] << bits) | p[:, 2], weights=counts, minlength=1 << 3 * bits).astype(np.int64)


def payload(text: str) -> tuple[bytes, int]:
    """A text's UTF-8 with zeros up to a positive multiple of 64, and its own length."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the GIF that holds the text."""

    def factory() -> Callable[[str], tuple]:
        def row(text: str) -> tuple:
            data, n = payload(text)
            return n, encode(data, compress=True)

        return row

    return map_texts(docs, factory, [("n_bytes", "long", pa.int64()), ("gif", "binary", pa.binary())], id_col, text_col)


FRAME_SQL = "array<struct<frame:long,start_ms:long,delay_ms:long,left:long,top:long,width:long,height:long,histogram:array<long>>>"


def frames(media: DataFrame, id_col: str = "doc_id", gif_col: str = "gif") -> DataFrame:
    """A row for each frame of each GIF: times, place, and the samples (RGBA) and colour histogram of the whole canvas as shown.

    A broken file gives one row with its error.
    """
    spark = media.sparkSession
    ship(spark)
    bound_arrow(spark)
    numbers = ["frame", "start_ms", "delay_ms", "left", "top", "width", "height"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in numbers), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows, held = [], 0
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    start = 0
                    gif = decode(data or b"")
                    for k, (f, canvas) in enumerate(zip(gif.frames, shown(gif), strict=True)):
                        rows.append((doc, k, start, f.delay_ms, f.left, f.top, f.width, f.height, canvas.tobytes(), canvas_histogram(canvas).tolist(), None))
                        start += f.delay_ms
                        held += canvas.nbytes
                        if held > 1 << 24:
                            yield made(rows)
                            rows, held = [], 0
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((doc, *[None] * 9, str(e)))
            yield made(rows)

    rows = media.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{gif_col}`").cast("binary").alias("gif"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in numbers) + ", samples binary, histogram array<long>, error string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a GIF, read that back, and give the checksums and features of what was read."""

    def factory() -> Callable[[str], tuple]:
        def row(text: str) -> tuple:
            data, n = payload(text)
            stored = encode(data, compress=True)
            gif = decode(stored)
            parts, total = [], 0
            for f, canvas in zip(gif.frames, shown(gif), strict=True):
                parts.append(canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
                total = total + canvas_histogram(canvas)
            back = b"".join(parts)
            seen = ",".join(f"{i}:{v}" for i, v in enumerate(total.tolist()) if v)
            feature = f"{len(gif.frames)}x{gif.width}x{gif.height};{sum(f.delay_ms for f in gif.frames)}ms;{seen}"
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

        return row

    longs = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes"}
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return map_texts(docs, factory, [(n, "long", pa.int64()) if n in longs else (n, "string", pa.string()) for n in names], id_col, text_col)
