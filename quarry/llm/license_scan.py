"""License scans by a positional rare-token index.

Templates are word sequences with mandatory key phrases: short names, and whole
licence notices of which the key phrases must stand where the template has them.
The index maps every licence word to all its postings (template, position).  A
file's licence words are looked up from the highest IDF down: each occurrence,
shifted by the word's template position, is a diagonal of the template, and the
file's rarest words that a template needs intersect their diagonals, until one is
left or PROBES words were looked up.  What remains is verified against the key
phrases, word by word; a template of which the file lacks a needed word is never
looked at.  IDF comes from the document frequencies of the licence words over the
whole table (a count per licence word, so its size does not depend on the data).
IDF orders the lookups and never changes what is found: each place holds all
words of its key phrases.

Words: maximal runs of ASCII letters and digits (lower-cased) and of any
characters beyond ASCII.

Defined results: null text counts as empty; no words: zero counts, null
positions, empty labels, score 0; places may overlap and each counts, so ties need
no rule; very long texts are scanned whole like any other; repeated rows repeat;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, table, utf8_texts


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    #: Mandatory key phrases: (first word, number of words).
    keys: tuple[tuple[int, int], ...]
    base: bool


def _template(label: str, text: str, keys: Iterable[str] = (), base: bool = False) -> Template:
    words = tuple(text.encode().split())
    spans = []
    for key in keys or (text,):
        phrase = tuple(key.encode().split())
        spans.append((next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), len(phrase)))
    return Template(label, words, tuple(spans), base)


#: The contract's phrases, then this method's own.
TEMPLATES = (
    _template("gpl", "gnu general public license", base=True),
    _template("apache", "apache license", base=True),
    _template("cc-by", "cc by", base=True),
    _template("mit", "mit license", base=True),
    _template("agpl", "gnu affero general public license"),
    _template("lgpl", "gnu lesser general public license"),
    _template("gpl-2.0", "gnu general public license version 2"),
    _template("gpl-3.0", "gnu general public license version 3"),
    _template("apache-2.0", "apache license version 2 0"),
    _template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms"],
    ),
    _template(
        "bsd-notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"],
    ),
    _template("cc-by-text", "creative commons attribution"),
    _template("cc0", "creative commons zero"),
    _template("epl", "eclipse public license"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose"),
    _template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted free of charge", "any person obtaining a copy"]),
    _template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the software",
        ["permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies or substantial portions"],
    ),
    _template(
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["licensed under the apache license version 2 0", "you may not use this file except in compliance"],
    ),
    _template("mpl", "mozilla public license"),
    _template("spdx", "spdx license identifier"),
    _template("unlicense", "free and unencumbered software released into the public domain"),
)

#: Separators become spaces and ASCII capitals small letters; bytes beyond ASCII stay.
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def licence_words(templates: Iterable[Template] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in templates for w in t.words})


def document_frequencies(docs: DataFrame, templates: Iterable[Template] = TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each licence word, and under b"" all documents."""
    vocabulary = frozenset(licence_words(templates))

    def partial(batches):
        n, found = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in utf8_texts(batch):
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    found[w] += 1
        found = {w: c for w, c in found.items() if c} | {b"": n}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


#: Words of a template that are looked up before its key phrases are verified.
PROBES = 3


class RareTokenIndex:
    """Postings of all words of all templates, and the words that each template needs."""

    def __init__(self, frequencies: dict[bytes, int], templates: Iterable[Template] = TEMPLATES):
        self.templates = tuple(templates)
        total = frequencies.get(b"", 0)
        self.idf = {w: math.log((total + 1) / (frequencies.get(w, 0) + 1)) for w in licence_words(self.templates)}
        #: Word -> template -> the positions of the template's key phrases at which the word stands.
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        needed = []
        for t, template in enumerate(self.templates):
            own = [(template.words[i], i) for first, n in template.keys for i in range(first, first + n)]
            for w, i in own:
                self.postings.setdefault(w, {}).setdefault(t, []).append(i)
            needed.append(frozenset(w for w, _ in own))
        self.needed = tuple(needed)
        self.vocabulary = frozenset(self.postings)
        #: Every template needs one of these: its rarest word.  A file without any of them is done.
        self.rarest = frozenset(min(own, key=lambda w: (-self.idf[w], w)) for own in needed)

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """All (template, word position) where every key phrase of the template stands."""
        if self.rarest.isdisjoint(words):
            return []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                at.setdefault(w, []).append(i)
        held = at.keys()
        diagonals: dict[int, set[int]] = {}
        probes: dict[int, int] = {}
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for t, offsets in self.postings[w].items():
                if not self.needed[t] <= held:
                    continue
                n = probes.get(t, 0)
                if n >= PROBES or n and len(diagonals[t]) <= 1:
                    continue
                # a word that a template has twice lies on a diagonal by each of its positions: all of them must
                for offset in offsets:
                    found = {p - offset for p in at[w]}
                    diagonals[t] = diagonals[t] & found if t in diagonals else found
                probes[t] = n + 1
        out = []
        for t, starts in diagonals.items():
            template = self.templates[t]
            for start in starts:
                if all(start + i >= 0 and tuple(words[start + i : start + i + n]) == template.words[i : i + n] for i, n in template.keys):
                    out.append((t, start + template.keys[0][0]))
        return out


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_own", pa.int64()),
])


def scan_licenses(docs: DataFrame, templates: Iterable[Template] = TEMPLATES) -> DataFrame:
    """One row per document.  score: 1 - 0.5 ** places, base and own."""
    index = RareTokenIndex(document_frequencies(docs, templates), templates)

    def scan(batches):
        for batch in batches:
            out = {f.name: [] for f in _SCHEMA}
            for text in utf8_texts(batch):
                words = words_of(text)
                found = index.places(words)
                base = [p for t, p in found if index.templates[t].base]
                labels = {index.templates[t].label for t, _ in found}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min(base, default=None))
                out["last_word"].append(max(base, default=None))
                out["base_labels"].append(",".join(sorted({index.templates[t].label for t, _ in found if index.templates[t].base})))
                out["labels"].append(",".join(sorted(labels)))
                out["score"].append(1 - 0.5 ** len(found))
                out["n_own"].append(len(found) - len(base))
            yield arrow_rows(_SCHEMA, out | {"doc_id": batch.column(0)})

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_own long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, ddl)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    upper = "".join(map(chr, range(65, 91)))

    def phrase(words, first, at):
        return "w[{0}:{1}] = [{2}]".format(f"{at} + {first}", f"{at} + {first + len(words) - 1}", ", ".join(f"'{x.decode()}'" for x in words))

    lists = []
    for k, t in enumerate(TEMPLATES):
        n = t.keys[0][0]
        tests = " AND ".join(phrase(t.words[i : i + m], i - n, "i") for i, m in t.keys)
        lists.append(f"list_filter(range(1, len(w) + 1), lambda i: w[i] = '{t.words[n].decode()}' AND {tests}) AS t{k}")
    base = [k for k, t in enumerate(TEMPLATES) if t.base]
    label = lambda ks: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len(t{k}) > 0 THEN '{TEMPLATES[k].label}' END" for k in ks) + "], lambda x: x IS NOT NULL)), ',')"
    count = lambda ks: " + ".join(f"len(t{k})" for k in ks)
    every, own = range(len(TEMPLATES)), [k for k in range(len(TEMPLATES)) if k not in base]
    places = "list_concat(" * (len(base) - 1) + f"t{base[0]}" + "".join(f", t{k})" for k in base[1:])
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {", ".join(lists)} FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST({count(base)} AS BIGINT) AS n_base,
  CAST(list_min({places}) - 1 AS BIGINT) AS first_word, CAST(list_max({places}) - 1 AS BIGINT) AS last_word,
  {label(base)} AS base_labels, {label(every)} AS labels, 1 - pow(0.5::DOUBLE, {count(every)}) AS score, CAST({count(own)} AS BIGINT) AS n_own
FROM p"""


OP3_SQL = _op3_sql()
