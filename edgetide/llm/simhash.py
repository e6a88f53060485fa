"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of
their 8 bytes, the guaranteed minimum. A list for each single positional byte
would hold a 256th of all fingerprints, and tallies over its pairs would grow
with the square of the corpus. So lists are kept for sets of four positional
bytes. Of all such sets, the 14 whose places' numbers cancel out by exclusive
or are enough: any five places hold one of them, so every pair that reaches the
minimum meets in a list. For the pairs of a list the equal positional bytes are
tallied; those that reach the minimum are kept, and verified by their differing
bits.

A list of more than `crowd` distinct fingerprints isn't searched: its members
are listed anew by one more byte and six bits of the others, in all 16 ways, of
which every linked pair shares one. Such a list holds at most 2^18, whatever
the corpus. Copies are one entry. Within a list, links are followed from one
fingerprint to those not reached yet, so a large group of near copies costs one
row for each of its members, not one for each pair; what leaves it is a star for
each group linked there, which keeps every link's connection.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked
like any other; long texts are read whole; repeated rows are one entry of the
index and each get a row; null ids never name a component unless it has no
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import map_texts, place
from edgetide.operators.components import connected_components
from edgetide.session import arrow_batches, checkpoint, ship

SEED = 42
BYTES = 8


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles, as a signed integer. Only A-Z are lower-cased; words end at ASCII space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint."""

    def factory() -> Callable[[str], tuple]:
        return lambda text: (fingerprint(text),)

    return map_texts(docs, factory, [("fp", "long", pa.int64())], id_col, text_col)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks() -> list[int]:
    """The sets of four byte places whose numbers cancel out, as bits. Of any five places, four are such a set."""
    return [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(BYTES), 4) if chosen[0] ^ chosen[1] ^ chosen[2] ^ chosen[3] == 0]


def finer(mask: int) -> list[int]:
    """A mask with one more byte, and with six of the 24 bits that are left then. At most 3 differing bits spare one of the four bytes, then one of the four sixes."""
    out = []
    free = [p for p in range(BYTES) if not mask >> 8 * p & 1]
    for p in free:
        wide = mask | 0xFF << 8 * p
        bits = [8 * q + k for q in free if q != p for k in range(8)]
        out += [wide | sum(1 << b for b in bits[at : at + 6]) for at in range(0, 24, 6)]
    return out


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes of fingerprints are equal, given their exclusive or."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def linked(x: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs are linked, given their exclusive or: the tally reaches the minimum, and the differing bits are few enough."""
    out = np.zeros(len(x), dtype=bool)
    kept = np.flatnonzero(equal_bytes(x) >= BYTES - distance)
    out[kept] = np.bitwise_count(x[kept]) <= distance
    return out


def stars(values: np.ndarray, free: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of the distinct fingerprints of a posting that links of at most `distance` bits hold together: its least, and the others."""
    if len(values) > 20_000:
        yield from _stars_by_flips(values, free, distance)
        return
    left = values
    while len(left):
        group, queue, left = [left[:1]], [left[0]], left[1:]
        while queue and len(left):
            near = linked(left ^ queue.pop(), distance)
            if near.any():
                found = left[near]
                group.append(found)
                queue.extend(found)
                left = left[~near]
        members = np.concatenate(group)
        if len(members) > 1:
            least = members.min()
            yield int(least), members[members != least]


def _stars_by_flips(values: np.ndarray, free: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """The same for a crowded posting: neighbours are looked up by flipping up to `distance` of the bits that are free there."""
    places = [b for b in range(64) if free >> b & 1]
    flips = np.array([sum(1 << b for b in c) for k in range(1, distance + 1) for c in combinations(places, k)], dtype=np.uint64)
    ordered = np.sort(values)
    alive = np.ones(len(ordered), dtype=bool)
    for first in range(len(ordered)):
        if not alive[first]:
            continue
        alive[first] = False
        members, front = [ordered[first : first + 1]], ordered[first : first + 1]
        while len(front):
            found = []
            for at in range(0, len(front), 256):
                wanted = (front[at : at + 256, None] ^ flips[None, :]).reshape(-1)
                place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
                place = np.unique(place[(ordered[place] == wanted) & alive[place]])
                alive[place] = False
                found.append(ordered[place])
            front = np.concatenate(found)
            members.append(front)
        members = np.concatenate(members)
        if len(members) > 1:
            least = members.view(np.int64).min().astype(np.int64).view(np.uint64)
            yield int(least), members[members != least]


def listed(members: DataFrame, every: list[int], distance: int, crowd: int | None) -> DataFrame:
    """(u, v, c) from fingerprints `fp` and the numbers `c` of their masks: links, c being null; and the members u of lists of more than `crowd`, by c."""
    unsigned = np.array(every, dtype=np.uint64)
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*(F.lit(signed(m)) for m in every)), F.col("c") + 1))
    dealt = members.repartition(F.col("c"), key).sortWithinPartitions(F.col("c"), key)
    none = np.empty(0, dtype=np.uint64)

    def batch_of(us: list[np.ndarray], vs: list[np.ndarray], crowded: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate([none, *part]).view(np.int64) for part in (us, vs))
        full = sum(len(m) for _, m in crowded)
        u = pa.array(np.concatenate([u, *(m.view(np.int64) for _, m in crowded)]))
        c = [pa.nulls(len(v), pa.int32()), *(pa.array(np.full(len(m), k, dtype=np.int32)) for k, m in crowded)]
        return pa.RecordBatch.from_arrays([u, pa.concat_arrays([pa.array(v), pa.nulls(full, pa.int64())]), pa.concat_arrays(c)], names=["u", "v", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_c, open_fp = np.empty(0, dtype=np.int64), none
        hot: tuple[int, int] | None = None  # the crowded list that is open, by mask and key

        def settle(c: np.ndarray, fp: np.ndarray, last: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
            """Links of the lists that end here; of the open one, what is held on."""
            nonlocal hot
            masked = fp & unsigned[c]
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (masked[1:] != masked[:-1])) + 1, [len(c)]])
            us, vs, crowded = [], [], []
            begin, ends = starts[:-1], starts[1:]
            if len(begin) and hot is not None:
                if hot == (int(c[0]), int(masked[0])):
                    crowded.append((hot[0], fp[: ends[0]]))
                    begin, ends = begin[1:], ends[1:]
                if len(begin):
                    hot = None
            keep = len(c)
            if len(begin) and not last:
                keep = int(begin[-1])
                begin, ends = begin[:-1], ends[:-1]
            size = ends - begin
            pairs = begin[size == 2]
            a, b = fp[pairs], fp[pairs + 1]
            near = linked(a ^ b, distance)
            us.append(a[near])
            vs.append(b[near])
            for s, e in zip(begin[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                if crowd is not None and e - s > crowd:
                    crowded.append((int(c[s]), fp[s:e]))
                    continue
                for least, others in stars(fp[s:e], int(~unsigned[c[s]]), distance):
                    us.append(np.full(len(others), least, dtype=np.uint64))
                    vs.append(others)
            if crowd is not None and len(c) - keep > crowd:
                hot = int(c[keep]), int(masked[keep])
                crowded.append((hot[0], fp[keep:]))
                keep = len(c)
            return batch_of(us, vs, crowded), c[keep:], fp[keep:]

        for batch in batches:
            c, fp = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().view(np.uint64)
            if len(c):
                made, open_c, open_fp = settle(np.concatenate([open_c, c]), np.concatenate([open_fp, fp]), False)
                yield made
        if len(open_c):
            yield settle(open_c, open_fp, True)[0]

    return dealt.select("c", "fp").mapInArrow(run, "u long, v long, c int")


def links(distinct: DataFrame, distance: int = 3, crowd: int = 20_000) -> DataFrame:
    """(u, v): stars that connect exactly the fingerprints that links of at most `distance` bits (3 or fewer) connect."""
    if not 0 <= distance <= 3:
        raise ValueError("four places of five are shared for up to 3 differing bits")
    spark = distinct.sparkSession
    ship(spark)
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    with arrow_batches(spark, rows=65_536):
        every = masks()
        first = checkpoint(listed(distinct.select("fp", numbered(len(every)).alias("c")), every, distance, crowd))
        found, crowded = first.where("c is null").select("u", "v"), first.where("c is not null")
        if crowded.limit(1).count():
            fine = [m for mask in every for m in finer(mask)]
            ways = len(fine) // len(every)
            again = crowded.select(F.col("u").alias("fp"), "c", numbered(ways).alias("way")).select("fp", (F.col("c") * ways + F.col("way")).alias("c"))
            found = found.unionAll(checkpoint(listed(again, fine, distance, None)).select("u", "v"))
    return found.distinct()


def rooted(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, its least id, and the least fingerprint that its links reach; checkpointed."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), distance))
    return checkpoint(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def components(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, component_id): each distinct fingerprint with the least id that its links reach. `prints` is (doc_id, fp), read once."""
    known = rooted(prints, distance)
    return known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint in hexadecimal digits, and component_id of every document."""
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    known = components(prints)
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, that of the least doc_id, with all columns of `docs`.

    Groups are those of the digest: fingerprints of 3-word shingles within 3
    bits. Most near copies differ by more and stay; the README has figures.
    Rows that share their doc_id (or have none) are told apart by their
    fingerprint; where that agrees too, the least row stays.
    """
    prints = checkpoint(fingerprints(docs))
    # A row a fingerprint is enough to choose from, and it is aggregated before the shuffle.
    chosen = rooted(prints).groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("one"))
    chosen = checkpoint(chosen.select(F.col("one.least").alias("chosen_id"), F.col("one.fp").alias("chosen_fp")))
    twice = prints.groupBy(F.col("doc_id").alias("twice_id")).agg(F.count("*").alias("n")).where("n > 1 or twice_id is null").select("twice_id")
    names = [f"edgetide_{i}" for i in range(len(docs.columns))]  # columns of documents may bear any name
    rows = docs.toDF(*names)
    own = F.col(names[place(docs, "doc_id")]).cast("long")
    kept = rows.join(chosen, own.eqNullSafe(F.col("chosen_id")), "left_semi")
    if not twice.limit(1).count():
        return kept.toDF(*docs.columns)
    single = kept.join(twice, own.eqNullSafe(F.col("twice_id")), "left_anti")
    several = rows.join(twice, own.eqNullSafe(F.col("twice_id")), "left_semi")
    marked = several.withColumn("fp", _fingerprint_column(names[place(docs, "text")]))
    marked = marked.join(chosen, own.eqNullSafe(F.col("chosen_id")) & (F.col("fp") == F.col("chosen_fp")), "left_semi")
    # Rows are ordered by their text as JSON, as maps and variants have no order of their own.
    order = F.to_json(F.struct(*(n for n, f in zip(names, rows.schema.fields, strict=True) if not holds_variant(f.dataType))))
    least = marked.groupBy(own.alias("id"), "fp").agg(F.min_by(F.struct(*names), order).alias("row")).select("row.*")
    return single.unionByName(least).toDF(*docs.columns)


def holds_variant(kind) -> bool:  # noqa: ANN001
    return "variant" in kind.simpleString()


def _fingerprint_column(text: str):  # noqa: ANN202
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t or "")).astype("int64")

    return of(F.col(text))
