"""Own spans of the personal-data operator against a plain version, planted numbers, and scores by context."""

from __future__ import annotations

import random
import re

from edgetide.llm import pii

from . import cases


def make_iban(rnd, country):
    body = "".join(rnd.choice("0123456789") for _ in range(pii.IBAN_LENGTH[country] - 4))
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def grouped(s):
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def plain_ibans(t):
    """Every start, every end: the country's length, single spaces inside only, nothing that goes on, the right remainder."""
    out, done = [], 0
    for a in range(len(t)):
        if a < done or not re.match(r"[A-Z]{2}[0-9]{2}", t[a:]) or (a and t[a - 1].isascii() and t[a - 1].isalnum()):
            continue
        want = pii.IBAN_LENGTH.get(t[a : a + 2])
        for b in range(a + 15, min(len(t), a + 70) + 1):
            x = t[a:b]
            if want and re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", x) and len(x.replace(" ", "")) == want and not re.match(r"[A-Za-z0-9]", t[b:]) and pii.mod97(x):
                out.append((a, b))
                done = b
                break
    return out


def test_ibans_among_capitals():
    for t, number in (
        ("IBAN bank GB82 WEST 1234 5698 7654 32 OR other", "GB82 WEST 1234 5698 7654 32"),
        ("account DE89370400440532013000 CEO", "DE89370400440532013000"),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"),
    ):
        assert [t[s:e] for k, s, e, _ in pii.find(t) if k == "iban"] == [number]
    for t in ("bank DE89 3704 0044 0532 0130 01", "bank DE893704004405320130001", "bank ZZ89 3704 0044 0532 0130 00"):
        assert not [x for x in pii.find(t) if x[0] == "iban"]


def test_planted_ibans_are_found():
    rnd = random.Random(3)
    found = planted = 0
    for country in pii.IBAN_LENGTH:
        for _ in range(5):
            n = make_iban(rnd, country)
            n = grouped(n) if rnd.random() < 0.5 else n
            t = f"{rnd.choice(['pay to', 'Konto', 'IBAN:', 'THE'])} {n}{rnd.choice([' NOW', '.', ' and more', ''])}"
            spans = [t[s:e] for k, s, e, _ in pii.find(t) if k == "iban"]
            planted += 1
            found += spans == [n]
            assert [(s, e) for k, s, e, _ in pii.find(t) if k == "iban"] == plain_ibans(t)
    assert found == planted


def test_random_numbers_are_not_ibans():
    rnd = random.Random(4)
    t = " ".join(rnd.choice(list(pii.IBAN_LENGTH)) + "".join(rnd.choice("0123456789") for _ in range(20)) for _ in range(3000))
    assert len([x for x in pii.find(t) if x[0] == "iban"]) < 30  # a 97th of those of the right length


def test_context_moves_every_kind():
    for kind, plain, more, less in (
        ("email", "a@b.org", "email", "example"),
        ("ip", "10.0.0.1", "server", "version"),
        ("card", "4111111111111111", "visa", "isbn"),
        ("phone", "+1 555 123 4567", "mobile", "isbn"),
        ("iban", "DE89370400440532013000", "konto", "serial"),
    ):
        score = lambda t: {k: x for k, _, _, x in pii.find(t)}.get(kind, 0.0)  # noqa: E731,B023
        assert score(f"{more} {plain}") > score(f"ab {plain}") > score(f"{less} {plain}") >= 0
    assert [k for k, *_ in pii.find("version isbn 10.0.0.1 section")] == ["ip"]  # base kinds stay


def test_scores_leave_the_query(spark):
    rows = {r.doc_id: r for r in pii.digest(cases.docs(spark, [None, "", "mail a@b.org, visa 4111111111111111, version 1.2.3.4"], repeat=False)).collect()}
    assert rows[2].spans == "email:5:12,ip:45:52,card:19:35"
    assert rows[2].scores.split(",") == ["1.00", "0.20", "1.00"] and rows[2].n_likely == 2 and rows[0].scores == rows[1].scores == ""


def test_clashing_case(spark):
    """A column whose name differs by case only is another column."""
    from pyspark.sql import functions as F

    df = cases.docs(spark, ["x a@b.org"], repeat=False).select("*", F.lit("1.2.3.4").alias("Text"), F.lit(9).alias("DOC_ID"))
    r = pii.digest(df).first()
    assert (r.doc_id, r.n_email, r.n_ip) == (0, 1, 0)
