"""Personal data: expressions propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) follow fixed patterns and are always kept,
whatever their score. The method adds `iban` (of its country's length, spaces
between its groups, confirmed by mod-97) and `national` (a bare digit group that
only a nearby context word makes likely), kept where the score reaches
`threshold`. Every span's score starts from how much its pattern and checksum
say, and is moved by the context words around it, for each kind its own.

Defined cases: null and empty texts have no spans; long texts are scanned
whole, in linear time; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import map_texts

KINDS = ("email", "ip", "card", "phone", "iban", "national")
BASE = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A failed start inside a digit run fails at every later start of that run, so starting at its first digit loses nothing.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9])+")
NATIONAL = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{3}[ -][0-9]{2,4}[ -][0-9]{4}(?![0-9A-Za-z-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")
#: Letters and digits of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Fixed context words, by what they speak for or against.
CONTEXT = {
    "email": {"mail": 0.1, "email": 0.1, "contact": 0.1, "write": 0.1, "example": -0.3, "noreply": -0.2},
    "ip": {"ip": 0.3, "host": 0.2, "server": 0.2, "login": 0.3, "client": 0.2, "address": 0.2, "version": -0.4, "release": -0.4, "section": -0.3},
    "card": {"card": 0.3, "visa": 0.3, "mastercard": 0.3, "credit": 0.2, "debit": 0.2, "payment": 0.2, "karte": 0.2, "tarjeta": 0.2, "carte": 0.2, "isbn": -0.4, "tracking": -0.3, "serial": -0.3, "order": -0.2},
    "phone": {"phone": 0.3, "tel": 0.3, "call": 0.2, "mobile": 0.3, "fax": 0.2, "telefon": 0.3, "version": -0.3, "isbn": -0.4},
    "iban": {"iban": 0.3, "bank": 0.2, "account": 0.2, "konto": 0.2, "cuenta": 0.2, "compte": 0.2, "bic": 0.2, "serial": -0.3, "order": -0.2},
    "national": {"phone": 0.4, "tel": 0.4, "call": 0.4, "mobile": 0.4, "ssn": 0.5, "social": 0.3, "security": 0.2, "telefon": 0.4, "order": -0.3, "invoice": -0.3, "isbn": -0.5, "version": -0.4},
}
#: What a kind's pattern and checksum say before any context.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.7, "national": 0.2}


def luhn(digits: str) -> bool:
    """The Luhn checksum over a string of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 13616 check: rearranged and read in base 36, the remainder by 97 is 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no later match reaches back over this @
        at = text.find("@", done)
    return out


def context_score(text: str, start: int, end: int, kind: str, window: int) -> float:
    """The kind's base score, moved by context words within `window` code points."""
    around = text[max(0, start - window) : start] + " " + text[end : end + window]
    weights = CONTEXT[kind]
    return min(1.0, max(0.0, BASE_SCORE[kind] + sum(weights.get(w, 0.0) for w in set(WORD.findall(around.lower())))))


def ibans(text: str) -> list[tuple[int, int]]:
    """Numbers of their country's length whose check is right, and that no letter or digit continues."""
    out = []
    for m in IBAN.finditer(text):
        wanted = IBAN_LENGTH.get(m.group(1))
        at, n = m.start(), 0
        while wanted and n < wanted and at < m.end():
            n += text[at] != " "
            at += 1
        if wanted and n == wanted and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(text[m.start() : at]):
            out.append((m.start(), at))
    return out


def find(text: str, threshold: float = 0.5, window: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of each span, by kind as listed, then start; code points, end exclusive."""
    places = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if text.count(".") >= 3:
            for m in IP.finditer(text):
                parts = [p.lstrip("0") for p in m.group().split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    places.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                places.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    places.append(("phone", m.start(), m.end()))
        places += [("iban", s, e) for s, e in ibans(text)]
        places += [("national", m.start(), m.end()) for m in NATIONAL.finditer(text)]
    scored = [(k, s, e, context_score(text, s, e, k, window)) for k, s, e in places]
    return [x for x in scored if x[0] in BASE or x[3] >= threshold]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, window: int = 40) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, score, value)."""

    def factory() -> Callable[[str], tuple]:
        def row(text: str) -> tuple:
            return ([{"kind": k, "start": s, "end": e, "score": x, "value": text[s:e]} for k, s, e, x in find(text, threshold, window)],)

        return row

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())])
    return map_texts(docs, factory, [("spans", "array<struct<kind:string,start:long,end:long,score:double,value:string>>", pa.list_(span))], id_col, text_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans as one string, their scores in the same order, and how many score at least one half."""
    found = scan(docs, id_col, text_col)
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", as_text), ",").alias("spans"),
        *(count(k).alias(f"n_{k}") for k in KINDS[4:]),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size(F.filter("spans", lambda s: s["score"] >= 0.5)).cast("long").alias("n_likely"),
    )


__all__ = ["KINDS", "digest", "find", "luhn", "mod97", "scan"]
