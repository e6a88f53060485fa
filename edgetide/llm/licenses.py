"""License notices: base phrases, and an exact set-similarity search for templates.

Tokens are pairs of neighbouring words. A text block is a window of a quarter
more words than a template has, at any start; it meets the template where it
holds at least `threshold` of the template's distinct tokens. Such blocks are
found as in a set-similarity join: tokens are ordered by their document
frequency over the whole corpus, rarest first; only texts that hold a word of
the template's first tokens are looked into (prefix filter); a window must have
enough template tokens at all (length filter), and enough of the template must
be left from its rarest token on (positional filter); the overlap of what
remains is then counted. A window that starts between tokens holds no more than
the one that starts at the next token, so windows start at tokens.

Where windows of two templates overlap that share half of the lesser one's
tokens, but not all, the better one counts, so a notice of one GNU license is
not also one of another.

Everything is a DataFrame expression; only the template tokens' frequencies, as
many as there are such tokens, reach the driver.

Defined cases: null and empty texts have no words and no labels; long texts are
read whole, in time linear in their words; ties in frequency are ordered by
token; repeated rows get equal results; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import id_and_text

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {} for more details."""
CC = "This work is licensed under a Creative Commons {} 4.0 International License"
#: Fixed notices, as their publishers word them, and their labels.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License"),
    ("agpl-3.0", GNU.format("Affero General Public License", "3", "Affero General Public License")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by-4.0", CC.format("Attribution")),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", CC.format("Attribution-NonCommercial")),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", CC.format("Attribution-ShareAlike")),
    ("gpl-2.0", GNU.format("General Public License", "2", "General Public License")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", GNU.format("General Public License", "3", "General Public License")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl-3.0", GNU.format("Lesser General Public License", "3", "Lesser General Public License")),
    ("mit", "released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
)
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The containment that a block must reach.
THRESHOLD = 0.85
WINDOW = "array<struct<start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Template:
    """A notice as distinct tokens, rarest first, with the words that a block has and the tokens that it needs."""

    label: str
    tokens: tuple[str, ...]
    width: int
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        """A block that meets the template holds one of these."""
        return self.tokens[: len(self.tokens) - self.need + 1]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def templates(rank: dict[str, int], threshold: float = THRESHOLD) -> list[Template]:
    """TEMPLATES with their tokens in global order."""
    out = []
    for label, text in TEMPLATES:
        w = words_of(text)
        tokens = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}, key=rank.__getitem__)
        out.append(Template(label, tuple(tokens), len(w) + -(-len(w) // 4), max(1, math.ceil(threshold * len(tokens) - 1e-9))))
    return out


def kin(every: list[Template]) -> dict[int, list[int]]:
    """For each template those that share half of the lesser one's tokens, but not all."""
    near = lambda a, b: 0.5 <= len(set(a.tokens) & set(b.tokens)) / min(len(a.tokens), len(b.tokens)) < 1
    return {i: [j for j, b in enumerate(every) if i != j and near(a, b)] for i, a in enumerate(every)}


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the words of its text, A-Z lower-cased."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return id_and_text(docs, id_col, text_col).select("doc_id", F.array_remove(F.split(low, SPLIT, -1), "").alias("words"))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.lit(None).cast("array<string>")


def pairs(words: Column) -> Column:
    """Each word with its next one."""
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def vocabulary() -> list[str]:
    """The words of all templates, and their pairs."""
    texts = [words_of(t) for _, t in TEMPLATES]
    return sorted({w for t in texts for w in t} | {f"{a} {b}" for t in texts for a, b in zip(t, t[1:], strict=False)})


def ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """The template tokens, and the words that they are made of, by document frequency over the whole corpus, rarest first; equal tokens by their rarer word."""
    every = vocabulary()
    kind = lambda pair: strings([x for x in every if (" " in x) == pair])
    df = with_words(docs, id_col, text_col)
    found = df.select(F.explode(F.concat(F.array_intersect("words", kind(False)), F.array_intersect(pairs(F.col("words")), kind(True)))).alias("t"))
    counts = {r.t: r["count"] for r in found.groupBy("t").count().collect()}  # one row a template token or word
    return {t: k for k, t in enumerate(sorted(every, key=lambda t: (counts.get(t, 0), min(counts.get(w, 0) for w in t.split()), t)))}


def blocks(hits: Column, t: Template, number: dict[str, int]) -> Column:
    """The windows that meet a template: start, end (of its last token) and containment. `hits` are (at, number) of all template tokens in order."""
    ids = F.array(*(F.lit(number[x]) for x in t.tokens))
    size, need, reach = len(t.tokens), t.need, t.width - 2
    own = F.filter(hits, lambda h: F.array_contains(ids, h["number"]))

    def windows(own: Column) -> Column:
        begun = F.transform(own, lambda h, i: F.struct(h["at"].alias("start"), i.alias("i")))
        long_enough = F.filter(begun, lambda s: F.get(own, s["i"] + (need - 1))["at"] <= s["start"] + reach)

        def inside(s: Column) -> Column:
            return F.filter(F.slice(own, s["i"] + 1, F.lit(t.width)), lambda h: h["at"] <= s["start"] + reach)

        made = F.transform(long_enough, lambda s: F.struct(s["start"].alias("start"), inside(s).alias("h")))
        made = F.transform(made, lambda s: F.struct(s["start"].alias("start"), (F.element_at(s["h"], -1)["at"] + 2).alias("end"), F.array_sort(F.array_distinct(s["h"]["number"])).alias("block")))
        # Of the template, what comes before the block's rarest token is missing.
        left = F.filter(made, lambda s: F.lit(size) - F.array_position(ids, s["block"][0]) + 1 >= need)
        met = F.filter(left, lambda s: F.size(s["block"]) >= need)
        return F.transform(met, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.size(s["block"]) / F.lit(float(size))).alias("score")))

    return F.element_at(F.transform(F.array(own), windows), 1).cast(WINDOW)


def places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand one after the other, words from 0."""
    parts = phrase.split()
    here = lambda i: [F.get(words, i + k) == p for k, p in enumerate(parts)]

    def all_of(i: Column) -> Column:
        out = here(i)[0]
        for c in here(i)[1:]:
            out = out & c
        return out

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), all_of)).otherwise(F.lit(None).cast("array<int>"))


def scan(docs: DataFrame, rank: dict[str, int], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base places and labels, all labels, and the best containment that meets the threshold."""
    df = with_words(docs, id_col, text_col)
    words, none, nothing = F.col("words"), F.lit(None).cast("array<int>"), F.lit(None).cast(WINDOW)
    has = lambda p: F.array_contains(words, max(p.split(), key=len))
    df = df.withColumns({f"b{k}": F.when(has(p), places(words, p)).otherwise(none) for k, p in enumerate(PHRASES)})
    every = templates(rank, threshold)
    gate = F.arrays_overlap(words, strings(sorted({min(x.split(), key=rank.get) for t in every for x in t.prefix})))
    tokens = sorted((x for x in rank if " " in x), key=rank.get)
    number, in_order = {x: k + 1 for k, x in enumerate(tokens)}, strings(tokens)
    numbered = F.transform(pairs(words), lambda x, i: F.struct(i.alias("at"), F.array_position(in_order, x).cast("int").alias("number")))
    df = df.withColumn("hits", F.when(gate, F.filter(numbered, lambda h: h["number"] > 0)))
    df = df.withColumns({f"f{k}": F.when(F.size("hits") >= t.need, blocks(F.col("hits"), t, number)).otherwise(nothing) for k, t in enumerate(every)})

    def better(k: int) -> Column:
        """A template's windows that no window of its kin beats where they overlap."""
        def stays(w: Column) -> Column:
            out = F.lit(True)
            for j in kin(every)[k]:
                out = out & ~F.coalesce(F.exists(f"f{j}", overlaps(w)), F.lit(False))
            return out

        def overlaps(w: Column):  # noqa: ANN202
            return lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"]) & (x["score"] > w["score"])

        return F.filter(f"f{k}", stays)

    df = df.withColumns({f"t{k}": F.coalesce(F.array_max(F.transform(better(k), lambda w: w["score"])), F.lit(0.0)) for k in range(len(every))})
    base = [F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]
    more = [F.when(F.col(f"t{k}") > 0, F.lit(t.label)) for k, t in enumerate(every)]
    label_list = lambda c: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*c)))), ",")
    spots = F.flatten(F.array(*(F.coalesce(f"b{k}", F.lit(None).cast("array<int>"), F.array().cast("array<int>")) for k in range(len(PHRASES)))))
    df = df.withColumn("every", F.when(F.coalesce(*(F.col(f"b{k}") for k in range(len(PHRASES)))).isNotNull(), spots))
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.greatest(F.size("every"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        label_list(base).alias("base_labels"),
        label_list(base + more).alias("labels"),
        F.greatest(*(F.col(f"t{k}") for k in range(len(every)))).cast("double").alias("score"),
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL: every window that starts at a token of a template, its distinct tokens counted; no filter."""
    every = templates(dict.fromkeys(vocabulary(), 0), threshold)
    rows = ", ".join(f"({k}, '{x}')" for k, t in enumerate(every) for x in t.tokens)
    sizes = ", ".join(f"({k}, '{t.label}', {len(t.tokens)}, {t.width}, {t.need})" for k, t in enumerate(every))
    near = ", ".join(f"({k}, {j})" for k, js in kin(every).items() for j in js)
    phrase_places = []
    for p in PHRASES:
        parts = p.split()
        test = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))
        phrase_places.append(f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: {test})")
    names = ", ".join(f"{p} as b{k}" for k, p in enumerate(phrase_places))
    base = ", ".join(f"case when len(b{k}) > 0 then '{x}' end" for k, x in enumerate(PHRASES.values()))
    spots = " || ".join(f"b{k}" for k in range(len(PHRASES)))
    join = "coalesce(array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x is not null))), ','), '')"
    return f"""
    with words as (
        select row_number() over () as row, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    tokens(t, token) as (values {rows}),
    sizes(t, label, size, width, need) as (values {sizes}),
    near(t, other) as (values {near}),
    spread as (select row, unnest(range(0, len(w) - 1)) as spot, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as token from words where len(w) > 1),
    hits as (select row, spot, t, token from spread join tokens using (token)),
    windows as (
        select a.row, a.t, a.spot as start, max(b.spot) + 2 as stop, count(distinct b.token) / any_value(size)::double as score, any_value(label) as label
        from hits a join sizes s on a.t = s.t join hits b on a.row = b.row and a.t = b.t and b.spot between a.spot and a.spot + width - 2
        group by a.row, a.t, a.spot having count(distinct b.token) >= any_value(need)),
    kept as (
        select row, label, score from windows x where not exists (
            select 1 from windows y join near n on n.t = x.t and n.other = y.t
            where y.row = x.row and y.start < x.stop and x.start < y.stop and y.score > x.score)),
    found as (select row, list(distinct label) as more, max(score) as score from kept group by row),
    placed as (select row, doc_id, w, {names} from words),
    joined as (select doc_id, w, {spots} as b, [{base}] as base, coalesce(more, []) as more, coalesce(score, 0.0)::double as score from placed left join found using (row))
    select doc_id, len(w)::bigint as n_words, len(b)::bigint as n_base, list_min(b)::bigint as first_word, list_max(b)::bigint as last_word,
        {join.format('base')} as base_labels, {join.format('base || more')} as labels, score
    from joined"""
