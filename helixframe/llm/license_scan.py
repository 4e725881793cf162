"""Licence scans by a positional index of rare words, in Spark's own functions.

The index holds, for each licence template, the ANCHORS words of its mandatory key
phrase with the highest inverse document frequency over the whole corpus, and where they
stand in the template. In a file each place of such a word is a posting: the offset at
which the template would have to stand. The postings of a template's anchors are
intersected, so that only offsets on which all of them agree are left; these are accepted if
the key phrase stands there word for word and at least LEAST_SHARE of the template's
words are in place. As anchors are words of the key phrase, no place that would be
accepted is missed, whatever the frequencies are.

Base phrases are found apart from that, wherever their words stand consecutively.

Defined cases: a null text counts as empty: no words, no labels ('' and not null),
score 0. Repeated rows come back as often as they came; empty tables give empty
results; further columns are ignored. Texts may be of any length: work grows in
proportion to the words of texts that hold a key word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (phrase, label)
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
#: name: (label, template, its mandatory key phrase). Passages of the licences and of their usual notices.
TEMPLATES = {
    "apache-line": ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    "apache-notice": ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"),
    "apache-terms": ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing software distributed under the license"),
    "apache-grant": ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "perpetual worldwide non exclusive no charge royalty free irrevocable"),
    "bsd-grant": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "bsd-line": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "bsd-name": ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-warranty": ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "this software is provided by the copyright holders and contributors as is"),
    "cc-by-nc": ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    "cc0": ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "has dedicated the work to the public domain by waiving all"),
    "gpl-line": ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    "gpl-notice": ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "under the terms of the gnu general public license"),
    "isc": ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    "mit-line": ("mit", "released under the mit license", "under the mit license"),
    "mit-grant": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    "mit-short": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mit-warranty": ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied"),
    "mpl-line": ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    "mpl-notice": ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    "zlib": ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable for any damages arising from the use of this software"),
}
ANCHORS = 2
LEAST_SHARE = 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; lower() does just that, and faster, where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def file_words(low: Column) -> Column:
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all documents each of the key phrases' words stands. The vocabulary bounds the result."""
    words = docs.select(F.explode(F.array_intersect(file_words(lowered(F.col("text"))), F.array(*map(F.lit, vocabulary)))).alias("w"))
    found = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def key_start(template: str, key: str) -> int:
    words, phrase = template.split(), key.split()
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def build_index(frequency: dict[str, int], templates: dict[str, tuple[str, str, str]]) -> list[list[tuple[str, int]]]:
    """For each template the ANCHORS rarest words of its key phrase, and a place of each in the template."""
    index = []
    for _, text, key in templates.values():
        words, at = key.split(), key_start(text, key)
        rare = sorted(set(words), key=lambda w: (frequency[w], w))[:ANCHORS]
        index.append([(w, at + words.index(w)) for w in rare])
    return index


def _places(phrase: tuple[str, ...]) -> Column:
    """Positions in `w` where the phrase starts."""
    first = F.filter(F.transform("w", lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())

    def whole(i: Column) -> Column:
        test = F.lit(True)
        for k, word in enumerate(phrase[1:], 1):
            test = test & F.coalesce(F.get("w", i + k) == word, F.lit(False))
        return test

    return F.filter(first, whole)


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def accepted_places(templates: dict[str, tuple[str, str, str]], index: list[list[tuple[str, int]]]) -> tuple[Column, Column]:
    """met, the postings of all anchor words in `w`, and accepted (t, off, share) from column `met`."""
    words = lambda x: F.split(F.lit(x), " ")
    table = F.array(
        *(
            F.struct(
                F.lit(k).alias("t"), words(text).alias("words"), F.lit(key_start(text, key)).alias("key_at"), F.lit(len(key.split())).alias("key_len"),
                F.array(*(F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in anchors)).alias("anchors"),
            )
            for k, ((_, text, key), anchors) in enumerate(zip(templates.values(), index, strict=True))
        )
    )
    rare = sorted({w for anchors in index for w, _ in anchors})
    met = F.filter(F.transform("w", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    postings = lambda a: F.transform(F.filter("met", lambda m: m["w"] == a["w"]), lambda m: m["i"] - a["p"])
    agreed = lambda t: F.aggregate(F.slice(t["anchors"], 2, ANCHORS), postings(F.get(t["anchors"], F.lit(0))), lambda s, a: F.array_intersect(s, postings(a)))
    in_place = lambda t, off, j: F.coalesce(F.get("w", off + j) == F.get(t["words"], j), F.lit(False))
    places = lambda first, n: F.sequence(first, first + n - 1)
    whole_key = lambda t, off: F.forall(places(t["key_at"], t["key_len"]), lambda j: in_place(t, off, j))
    share = lambda t, off: F.size(F.filter(places(F.lit(0), F.size(t["words"])), lambda j: in_place(t, off, j))) / F.size(t["words"])
    found = lambda t: F.transform(F.filter(agreed(t), lambda off: whole_key(t, off)), lambda off: F.struct(t["t"].alias("t"), off.alias("off"), share(t, off).alias("share")))
    return met, F.filter(F.flatten(F.transform(table, found)), lambda c: c["share"] >= LEAST_SHARE)


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per document: n_words, places of the base phrases, base_labels, labels, score."""
    templates = TEMPLATES if templates is None else templates
    keys = [key.split() for _, _, key in templates.values()]
    index = build_index(document_frequency(docs, sorted({w for k in keys for w in k})), templates)
    # a text without any of these words has neither a base phrase nor a key phrase
    needed = {p[-1] for p, _ in BASE}
    for key in keys:
        if not needed.intersection(key):
            needed.add(max(key, key=lambda w: (len(w), w)))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), lowered(F.col("text")).alias("low"))
    may = F.lit(False)
    for word in sorted(needed):
        may = may | F.contains("low", F.lit(word))
    rows = rows.withColumn("w", F.when(may, file_words(F.col("low"))).otherwise(F.array().cast("array<string>"))).drop("low")

    base = F.array().cast("array<struct<at:int,label:string>>")
    for phrase, label in BASE:
        base = F.concat(base, F.transform(_places(phrase), _labelled(label)))
    met, accepted = accepted_places(templates, index)
    rows = rows.withColumn("base", base).withColumn("met", met).withColumn("accepted", F.when(F.size("met") > 0, accepted).otherwise(F.array().cast("array<struct<t:int,off:int,share:double>>")))
    label = F.array(*(F.lit(name) for name, _, _ in templates.values()))
    of_base = F.transform("base", lambda b: b["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).cast("long").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.concat(of_base, F.transform("accepted", lambda c: F.get(label, c["t"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform("accepted", lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"({_sql_list(list(p))}, '{label}')" for p, label in BASE)
_LICENCES = ", ".join(f"('{label}', {_sql_list(text.split())}, {_sql_list(key.split())}, {key_start(text, key)})" for label, text, key in TEMPLATES.values())
ORACLE = f"""
WITH f AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}),
licences(label, words, key, key_at) AS (VALUES {_LICENCES}),
base AS (SELECT r, label, i FROM (SELECT r, w, label, p, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = p[1])) AS i FROM f, phrases) WHERE w[i:i + len(p) - 1] = p),
keyed AS (SELECT * FROM (SELECT r, w, label, words, key, key_at, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1])) AS i FROM f, licences) WHERE w[i:i + len(key) - 1] = key),
shares AS (SELECT r, label, len(list_filter(range(1, len(words) + 1), lambda j: i - key_at + j - 1 >= 1 AND w[greatest(i - key_at + j - 1, 1)] = words[j])) / len(words)::DOUBLE AS share FROM keyed),
b AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
x AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM shares WHERE share >= {LEAST_SHARE}) GROUP BY r),
y AS (SELECT r, max(share) AS score FROM shares WHERE share >= {LEAST_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM f LEFT JOIN b USING (r) LEFT JOIN x USING (r) LEFT JOIN y USING (r)
"""
