"""Packing of documents into fixed windows by the online sum-of-squares rule.

Whole windows are cut from a long document at once; its rest goes to the fill
level that makes the sum of squared counts of partially filled windows least,
found in an array of counts by level; of equal levels the fullest, and a new
window only where that is strictly better. Each partition packs its documents
as they come. What its open windows hold at the end is carried to a second
pass, where the carried rests of many partitions, about `GROUP` documents at a
time, are placed anew by the same rule. Only what a group leaves open is cut:
the fullest windows are filled from the emptiest, and the last of them ends in
sequences whose lengths are powers of two. So no sequence is padded.

Memory is bounded by `max_open` windows: beyond it, two windows of the most
crowded level are joined, or one is filled from the other, whose rest is placed
anew. Column `closed` says how a sequence was closed: whole (cut from one
document), rule (filled to the brim by it), cut (as above).

Ids come from the tokenizers library, each distinct piece of plain text once.

Defined cases: a null or empty text is the closing id alone; long texts are
cut; repeated rows are packed each; an empty table gives an empty result; other
columns are ignored. Which documents share a sequence depends on how the input
is dealt to partitions; a sequence's id holds its partition or group, and the
first pass is checkpointed, so what is computed again after a loss is the same.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import id_and_text, texts
from edgetide.llm.wordbpe import MEMO_PIECES, PIECES, is_plain
from edgetide.session import bound_arrow, checkpoint, ship

Piece = tuple[int, int, bytes, int]  # row of the document, start, ids, its document's tokens


def gaps(values: list) -> Iterator[int]:
    """Where a list has None."""
    at = -1
    try:
        while True:
            yield (at := values.index(None, at + 1))
    except ValueError:
        return


class LibraryIds:
    """Ids by the tokenizers library as little-endian unsigned 32-bit integers; plain pieces are looked up once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True  # a word's last token bears the end mark

    def packed(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode_all(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of each text; the batch's unknown pieces go to the library in one call."""
        split = [PIECES.findall(t.lower()) if is_plain(t) and "<|" not in t else None for t in batch]
        known = self.pieces
        if len(known) > MEMO_PIECES:
            known.clear()
        found = [None if ps is None else list(map(known.get, ps)) for ps in split]
        holes = [(k, j) for k, ids in enumerate(found) if ids for j in gaps(ids)]
        new = list({split[k][j] for k, j in holes})
        if new:
            e = self.tokenizer.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0]  # a piece is one word there
            ids = np.array(e.ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            ids = ids.tobytes()
            known.update((p, ids[a:b]) for p, a, b in zip(new, cuts[:-1], cuts[1:], strict=True))
            for k, j in holes:
                found[k][j] = known[split[k][j]]
        for text, ids in zip(batch, found, strict=True):
            yield self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if ids is None else b"".join(ids)


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """The library's ids of a path, with the pieces known so far, once per worker."""
    return LibraryIds(path)


def tokens_of(window: list[Piece]) -> int:
    return sum(len(p[2]) for p in window) // 4


def split(window: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first `n` tokens of some pieces, and the others."""
    first: list[Piece] = []
    for k, (row, start, ids, total) in enumerate(window):
        here = len(ids) // 4
        if here > n:
            head = [(row, start, ids[: 4 * n], total)] if n else []
            return first + head, [(row, start + n, ids[4 * n :], total), *window[k + 1 :]]
        first.append(window[k])
        n -= here
    return first, []


class LevelPacker:
    """Windows of `size` tokens, open ones counted by fill level. `done` holds (how it was closed, pieces)."""

    def __init__(self, size: int, max_open: int = 4096):
        self.size, self.max_open = size, max(1, max_open)
        self.done: list[tuple[str, list[Piece]]] = []
        self.clear()

    def clear(self) -> None:
        """Forget all open windows."""
        self.level = np.zeros(self.size + 1)
        self.level[self.size] = -0.5  # a window that is filled leaves the sum
        self.windows: list[list[list[Piece]]] = [[] for _ in range(self.size)]
        self.open = 0

    def add(self, row: int, ids: bytes) -> None:
        """Place one document's ids."""
        size, total = self.size, len(ids) // 4
        cut = total - total % size
        for start in range(0, cut, size):
            self.done.append(("whole", [(row, start, ids[4 * start : 4 * (start + size)], total)]))
        if rest := total - cut:
            self.place((row, cut, ids[4 * cut :], total), rest)

    def place(self, piece: Piece, n: int) -> None:
        """Put a piece of `n` tokens where the sum of squares becomes least."""
        size, level = self.size, self.level
        here = level[1 : size - n + 1]
        cost = np.where(here > 0, 2 * (level[n + 1 :] - here) + 2, np.inf)
        best = size - n - int(np.argmin(cost[::-1])) if len(cost) else 0  # of equal ones the fullest
        if not len(cost) or cost[best - 1] > 2 * level[n] + 1:
            best, window = 0, []
        else:
            window = self.take(best)
        window.append(piece)
        self.put(window, best + n, "rule")
        while self.open > self.max_open:
            self.relieve()

    def take(self, fill: int) -> list[Piece]:
        self.level[fill] -= 1
        self.open -= 1
        return self.windows[fill].pop()

    def put(self, window: list[Piece], fill: int, how: str) -> None:
        if fill == self.size:
            self.done.append((how, window))
        else:
            self.windows[fill].append(window)
            self.level[fill] += 1
            self.open += 1

    def relieve(self) -> None:
        """One open window less: two of the most crowded level are joined, or one filled from the other; of equal levels the fullest."""
        fill = self.size - 1 - int(np.argmax(self.level[: self.size][::-1]))
        first = self.take(fill)
        other = fill if self.level[fill] else self.size - 1 - int(np.argmax(self.level[: self.size][::-1] > 0))
        second = self.take(other) if self.open else []
        head, rest = split(second, self.size - fill)
        window = first + head
        self.put(window, tokens_of(window), "cut")
        for p in rest:
            self.place(p, len(p[2]) // 4)

    def carry(self) -> list[Piece]:
        """All pieces of the open windows, in order of their documents; none stays open."""
        pieces = sorted((p for level in self.windows for w in level for p in w), key=lambda p: (p[0], p[1]))
        self.clear()
        return pieces

    def settle(self) -> None:
        """Close all open windows: the fullest are filled from the emptiest, and the last ends in powers of two."""
        left = [w for level in reversed(self.windows) for w in level]
        self.clear()
        at, last = 0, len(left) - 1
        while at <= last:
            window, room = left[at], self.size - tokens_of(left[at])
            at += 1
            while room and at <= last:
                head, left[last] = split(left[last], room)
                window = window + head
                room -= tokens_of(head)
                last -= not left[last]
            if not room:
                self.done.append(("cut", window))
                continue
            while window:
                head, window = split(window, 1 << (tokens_of(window).bit_length() - 1))
                self.done.append(("cut", head))


NUMBERS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in NUMBERS), ("closed", pa.string()), ("part", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", closed string, part long, row long, ids binary"
#: Documents of a group of the second pass, about.
GROUP = 16_384
#: Sequence ids of the second pass start here; those of the first are below it.
SECOND = 1 << 61


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def closed_rows(packer: LevelPacker, names: dict[int, int | None], sequence: int, with_ids: bool) -> list[tuple]:
    """A row for each piece of the closed windows, numbered from `sequence` on; the packer forgets them."""
    rows = []
    for k, (how, window) in enumerate(packer.done):
        offset = 0
        for at, start, ids, total in window:
            n = len(ids) // 4
            rows.append((names[at], start, n, zlib.crc32(ids), total, sequence + k, offset, how, None, None, ids if with_ids else None))
            offset += n
    packer.done = []
    return rows


def first_pass(docs: DataFrame, path: str, size: int, closing_id: int, max_open: int, with_ids: bool) -> DataFrame:
    """Closed sequences of each partition, and rows without a sequence for the pieces it left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, close = library_ids(path), LevelPacker(size, max_open), np.array([closing_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        sequence, names, row = part << 36, {}, 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_all(texts(batch)), strict=True):
                names[row] = doc
                packer.add(row, ids + close)
                row += 1
            closed = len(packer.done)
            yield batch_of(closed_rows(packer, names, sequence, with_ids))
            sequence += closed
            still = {p[0] for level in packer.windows for w in level for p in w}
            names = {k: v for k, v in names.items() if k in still}
        left = packer.carry()
        for at in range(0, len(left), 1000):
            yield batch_of([(names[k], start, len(ids) // 4, None, total, None, None, None, part, k, ids) for k, start, ids, total in left[at : at + 1000]])

    return docs.mapInArrow(run, DDL)


def second_pass(carried: DataFrame, size: int, max_open: int, with_ids: bool) -> DataFrame:
    """Sequences of the carried pieces, group by group; all are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, sequence, names, row = LevelPacker(size, max_open), None, 0, {}, 0
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("bin", "doc_id", "start", "doc_tokens", "ids")]
            for here, doc, start, total, ids in zip(*columns, strict=True):
                if here != group:
                    packer.settle()
                    out += closed_rows(packer, names, sequence, with_ids)
                    group, sequence, names, row = here, SECOND + (here << 36), {}, 0
                names[row] = doc
                packer.place((row, start, ids, total), len(ids) // 4)
                row += 1
            closed = len(packer.done)
            out += closed_rows(packer, names, sequence, with_ids)
            sequence += closed
            yield batch_of(out)
        packer.settle()
        yield batch_of(closed_rows(packer, names, sequence, with_ids))

    return carried.mapInArrow(run, DDL)


def pack(docs: DataFrame, path: str, size: int = 2048, closing_id: int = 1, max_open: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document, start and length there, checksum, sequence and offset there, how it was closed; on request its ids."""
    spark = docs.sparkSession
    ship(spark)
    bound_arrow(spark)
    first = checkpoint(first_pass(id_and_text(docs, id_col, text_col), path, size, closing_id, max_open, with_ids))
    kept, carried = first.where("sequence_id is not null"), first.where("sequence_id is null")
    some = carried.agg(F.count("*").alias("n"), F.max("part").alias("last")).first()
    groups, parts = max(1, -(-some["n"] // GROUP)), (some["last"] or 0) + 1
    carried = carried.withColumn("bin", F.floor(F.col("part") * groups / parts)).repartition("bin").sortWithinPartitions("bin", "part", "row", "start")
    packed = kept.unionAll(second_pass(carried.select("bin", "doc_id", "start", "doc_tokens", "ids"), size, max_open, with_ids))
    out = packed.select("doc_id", *NUMBERS, "closed", *(["ids"] if with_ids else []))
    if not with_ids:
        return out
    schema = pa.schema([*[f for f in SCHEMA if f.name not in ("part", "row", "ids")], ("ids", pa.list_(pa.int64()))])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, dtype="<u4").astype(np.int64) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, schema.field("ids").type)], schema=schema)

    return out.mapInArrow(numbers, "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", closed string, ids array<long>")
