"""License scans: an exact set-similarity join of text blocks with license templates.

Every run of words of a text is a block, of a length that suits the template: a template of n words is looked for among
`reach(n)` words in a row, whatever lines and sentences they stand in. A block meets a template if it holds at least
CONTAINMENT of the template's distinct words.
The words of all templates are put into one order, the rarest in the corpus first. A block that meets a template must
hold one of the template's first words in that order (prefix filter), must have enough template words at all (length
filter), and must have enough of them left behind the first match (positional filter). The filters first tell which
templates a text as a whole may meet; then only blocks around a template's first words are counted in full.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import ASCII_UPPER, table

# Phrases whose places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license notices, sentences and whole ones, with their labels.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "copyright all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that "
        "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]
CONTAINMENT = 0.9
#: Other words (names, years, comment marks) that may at least stand among those of a template in a block.
SLACK = 16

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())
#: Rows of one Arrow batch that are looked at together.
SLICE_ROWS = 512


def needed(size: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of so many distinct words that a block must hold."""
    return math.ceil(round(size * containment, 9))


def reach(size: int) -> int:
    """Words of a block in which a template of so many words is looked for."""
    return size + max(size, SLACK)


class Index:
    """The templates, by the first words of each in the corpus-wide order."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], containment: float = CONTAINMENT):
        words = {w for _, t in templates for w in t.encode().split()}
        self.rank = {w: i for i, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix, self.prefixes, self.reach = [], {}, [], []
        for label, text in templates:
            ordered = sorted({self.rank[w] for w in text.encode().split()})
            need = needed(len(ordered), containment)
            for position, word in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(word, []).append((len(self.templates), position))
            self.prefixes.append(frozenset(ordered[: len(ordered) - need + 1]))
            self.templates.append((label, frozenset(ordered), len(ordered), need))
            self.reach.append(reach(len(text.split())))
        self.first_words = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def meets(self, words: Collection[bytes]) -> dict[int, float]:
        """Templates of which these words hold enough, with the share of each that they hold."""
        if self.first_words.isdisjoint(words):
            return {}
        own = sorted({self.rank[w] for w in words if w in self.rank})
        found: dict[int, float] = {}
        tried = set()
        for at, word in enumerate(own):
            for template, position in self.prefix.get(word, ()):
                if template in tried:
                    continue
                tried.add(template)  # its first match: no earlier word of the block is in the template's prefix
                _, whole, size, need = self.templates[template]
                if len(own) < need or 1 + min(size - position - 1, len(own) - at - 1) < need:
                    continue
                if (common := len(whole.intersection(own))) >= need:
                    found[template] = common / size
        return found

    def best(self, template: int, ranks: list[tuple[int, int]]) -> float:
        """The largest share of the template that a block holds, 0 if none meets it. ranks are the place and rank of the
        text's words that some template has, in order."""
        _, whole, size, need = self.templates[template]
        width = self.reach[template]
        first = [i for i, r in ranks if r in self.prefixes[template]]
        # A word with none of the first words within reach is in no block that meets the template.
        at = [(i, r) for i, r in ranks if r in whole and bisect.bisect_right(first, i - width) < bisect.bisect_left(first, i + width)]
        held: Counter = Counter()
        most = low = 0
        for i, r in at:
            held[r] += 1
            while at[low][0] <= i - width:
                gone = at[low][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                low += 1
            most = max(most, len(held))
        return most / size if most >= need else 0.0


def word_frequency(docs: DataFrame, text: str, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Texts of the whole corpus that hold each word of the templates; a row for each such word at most."""
    wanted = frozenset(w for _, t in templates for w in t.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for doc in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    total.update(wanted.intersection(WORD.findall((doc or "").encode().translate(LOWER))))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


SCANNED = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("n_templates", T.LongType())]


def scan(docs: DataFrame, text: str, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each row of docs: keys, words, phrase places, labels and score.

    labels joins the phrases' labels with those of the templates that some block of the text meets; n_templates counts
    these templates. score is 1 where a phrase stands, else the largest share of a template that a block holds among those
    that meet it, else 0. A null text is an empty one: no words, null first and last word, empty labels. Equal rows each
    keep their row; no rows give none. Other columns of docs are not looked at.
    """
    frequency = word_frequency(docs, text, templates)
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(n, t) for n, t in SCANNED)])
    order = [(p.encode().split(), label) for p, label in phrases.items()]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency, containment)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows = [judge(index, order, (doc or "").encode().translate(LOWER)) for doc in batch.column(len(keys)).to_pylist()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(SCANNED)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(keys))), *arrays], names=schema.fieldNames())

    return docs.select(*(F.col(k) for k in keys), F.col(text)).mapInArrow(judged, schema)


def judge(index: Index, phrases: list[tuple[list[bytes], str]], data: bytes) -> tuple:
    """The values of SCANNED for one lower-cased text."""
    words = WORD.findall(data)
    at: list[int] = []
    labels = set()
    present = set(words)
    for phrase, label in phrases:
        if not present.issuperset(phrase):
            continue
        i = -1
        while True:
            try:
                i = words.index(phrase[0], i + 1)
            except ValueError:
                break
            if words[i : i + len(phrase)] == phrase:
                at.append(i)
                labels.add(label)
    met = {}
    if not index.first_words.isdisjoint(present):
        if whole := index.meets(present):  # only templates that the text as a whole meets can be met by a block
            ranks = [(i, index.rank[w]) for i, w in enumerate(words) if w in index.rank]
            met = {t: share for t in whole if (share := index.best(t, ranks))}
    more = {index.templates[t][0] for t in met}
    best = 1.0 if at else max(met.values(), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), best, len(met)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


def _templates_sql() -> str:
    rows = []
    for n, (label, text) in enumerate(TEMPLATES):
        words = sorted(set(text.split()))
        rows.append(f"({n}, '{label}', {words}, {needed(len(words))}, {reach(len(text.split()))})")
    return "(VALUES " + ", ".join(rows) + ") AS t(template, label, words, need, reach)"


def _phrase_sql(words: list[str]) -> str:
    return " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}') AS s FROM documents
), w AS (
  SELECT r, doc_id, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), p AS (
  SELECT r, doc_id, len(w) AS n_words, list_concat({", ".join(f"list_transform(list_filter(range(len(w)), lambda i: {_phrase_sql(p.split())}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items())}) AS hits FROM w
), t AS (
  SELECT template, label, unnest(words) AS word, len(words) AS size, need, reach FROM {_templates_sql()}
), v AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w
), m AS (
  SELECT r, template, label, size, need, count(DISTINCT word) OVER (PARTITION BY r, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND reach - 1 FOLLOWING) AS common
  FROM v JOIN t USING (word)
), b AS (
  SELECT r, template, label, max(common) / max(size) AS share FROM m GROUP BY r, template, label HAVING max(common) >= max(need)
), f AS (
  SELECT r, list(DISTINCT label) AS more, max(share) AS best, count(*) AS n_templates FROM b GROUP BY r
)
SELECT p.doc_id, n_words, len(hits)::BIGINT AS n_base, list_min(list_transform(hits, lambda h: h.at))::BIGINT AS first_word,
  list_max(list_transform(hits, lambda h: h.at))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda h: h.label), coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score, coalesce(n_templates, 0)::BIGINT AS n_templates
FROM p LEFT JOIN f USING (r)
"""
