"""BPE encoding and decoding with word ends, by a contiguous rank array.

Each short word is an array of parts and an array of the ranks of adjacent
pairs. The least rank is found by a scan, its boundary deleted, and the two
neighbouring ranks refreshed. Words beyond `SCAN_LIMIT` parts take a heap over
the same pairs, in the same order, so that cost stays near linear.

The vocabulary file is named by a path parameter and read on each worker.

Defined cases: null and empty texts have no tokens and decode to empty; long
texts and long words are encoded whole; repeated rows give equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from edgetide.llm.arrow import map_texts

SCAN_LIMIT = 256
#: Pieces kept with their ids, per worker; beyond it that memory starts anew.
MEMO_PIECES = 500_000
#: Texts of these characters are in NFC already, have a plain lower case, and only ASCII space.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞₠-₿]*\Z")


def plain_class(kind: str) -> str:
    """The plain characters of a general category, as ranges of a character class."""
    points = [c for c in range(0x21, 0x20C0) if PLAIN.match(chr(c)) and unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in points if c - 1 not in points]
    ends = [c for c in points if c + 1 not in points]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


CONTROL = re.compile(r"[^\t\n\r\x20-\x7e]")


def is_plain(text: str) -> bool:
    """Whether PLAIN holds; ASCII texts take a quicker scan."""
    return not CONTROL.search(text) if text.isascii() else bool(PLAIN.match(text))


#: How the vocabulary's file splits text, for plain characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^\sLN]+".replace("L", plain_class("L")).replace("N", plain_class("N")))
UNKNOWN = 1 << 60


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The usual printable stand-in for each byte: itself where printable, else letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


class WordBpe:
    """A vocabulary with its merges, and encoding and decoding by it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
        self.ranks = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[a] << 32 | vocab[b]] = (r, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + suffix] for b in range(256)]
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        self.path = path
        self.pieces: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SCAN_LIMIT:
            return self.merge_long(parts)
        ranks = self.ranks
        adjacent = [ranks.get(a << 32 | b, (UNKNOWN,))[0] for a, b in zip(parts, parts[1:], strict=False)]
        while adjacent and (least := min(adjacent)) != UNKNOWN:
            i = adjacent.index(least)
            parts[i : i + 2] = [ranks[parts[i] << 32 | parts[i + 1]][1]]
            del adjacent[i]
            if i < len(adjacent):
                adjacent[i] = ranks.get(parts[i] << 32 | parts[i + 1], (UNKNOWN,))[0]
            if i:
                adjacent[i - 1] = ranks.get(parts[i - 1] << 32 | parts[i], (UNKNOWN,))[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, by a heap of (rank, position)."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(a << 32 | b))]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (r := ranks.get(parts[i] << 32 | parts[j])):
                heapq.heappush(heap, (r[0], i, parts[i], parts[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = ranks[a << 32 | b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p >= 0]

    @property
    def library(self):  # noqa: ANN201
        """The library's normalizer and splitter, for texts beyond the plain range."""
        return _library(self.path)

    def encode_plain(self, text: str) -> bytes:
        """The ids of a plain text, each distinct piece merged once while it is kept."""
        out, known = [], self.pieces
        for p in PIECES.findall(text.lower()):
            ids = known.get(p)
            if ids is None:
                ids = array("I", self.merge(p.encode())).tobytes()
                if len(p) <= 64:
                    if len(known) >= MEMO_PIECES:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if self.split_special and "<|" in text:
            out = []
            for k, part in enumerate(self.split_special.split(text)):
                out.append(np.array([self.special[part]], dtype="<u4").tobytes() if k % 2 else self.encode_part(part))
            return b"".join(out)
        return self.encode_part(text)

    def encode_part(self, text: str) -> bytes:
        if not is_plain(text):
            lib = self.library
            letters = {c: b for b, c in byte_letters().items()}
            pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
            return np.array([i for p, _ in pieces for i in self.merge(bytes(letters[c] for c in p))], dtype="<u4").tobytes()
        return self.encode_plain(text)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text's UTF-8 for ids given as by encode. Without a decoder in the file, tokens are joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def _library(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The vocabulary of a path, once per worker."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array) and the decoded text of every document."""

    def factory() -> Callable[[str], tuple]:
        bpe = load(path)

        def row(text: str) -> tuple:
            ids = bpe.encode(text)
            return np.frombuffer(ids, dtype="<u4").astype(np.int64), bpe.decode(ids).decode("utf-8", "replace")

        return row

    return map_texts(docs, factory, [("ids", "array<long>", pa.list_(pa.int64())), ("decoded", "string", pa.string())], id_col, text_col)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, made where the text is read."""

    def factory() -> Callable[[str], tuple]:
        bpe = load(path)

        def row(text: str) -> tuple:
            ids = bpe.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return row

    return map_texts(docs, factory, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], id_col, text_col)
