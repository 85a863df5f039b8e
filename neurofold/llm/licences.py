"""Licence scan with a positional rare-token index, in DataFrame functions only.

The index holds, for every passage of a licence (``TEMPLATES``), the places of its words.
Words get an inverse document frequency from the whole corpus.  For each passage whose
key phrases' words a file has, the file's own highest-IDF words of that passage are
looked up; each place of such a word votes for a start (place in the file - place in the
passage), so postings are intersected by relative position.  A start with enough votes is
verified: the passage's mandatory key phrases must stand at their relative places, and
enough of all its words at theirs.

A licence has several passages, so that text put between them (a name, a heading) does
not hide it.  The base labels are the fixed phrases of ``PHRASES``, found wherever their
words stand consecutively; the method adds the labels of verified passages.

Everything about a file is decided inside its row, so repeated rows, repeated ids and
null ids cannot meet.  Only document frequencies are gathered, one count for each word
of the templates.

Defined results: null and empty texts have no words, no labels and score 0; repeated
rows are rows of their own with equal results; ties of frequency go by word; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Passages of public licences and licence notices: label, text, mandatory key phrases.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["free of charge to any person obtaining a copy"]),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["to deal in the software without restriction", "modify merge publish distribute sublicense"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "appear in all copies"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2", "you may not use this file except in compliance"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License", ["unless required by applicable law or agreed to in writing", "specific language governing permissions and limitations"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"]),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license as published by the free software foundation"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license as published by the free software foundation"]),
    ("agpl-3", "licensed under the GNU Affero General Public License version 3", ["gnu affero general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["terms of the mozilla public license v 2 0"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["without any express or implied warranty", "authors be held liable for any damages arising from the use"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international license"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
]
#: Words of a file that are looked up for a passage, rarest first; share of their postings, and of the passage's words, that a start must gather.
LOOKED_UP = 5
LEAST_SHARE = 0.6
OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(OUTSIDE, text.lower()) if w]


def lowered(text: Column) -> Column:
    """A-Z to lower case.  lower() does that faster wherever no other letter turns into an ASCII one."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def passages() -> list[dict]:
    """The templates as records: words, and each key phrase with its place among them."""
    out = []
    for label, text, keys in TEMPLATES:
        words = words_of(text)
        found = []
        for key in map(str.split, keys):
            found.append({"at": next(i for i in range(len(words)) if words[i : i + len(key)] == key), "words": key})
        out.append({"label": label, "words": words, "keys": found, "key_words": sorted({w for k in found for w in k["words"]})})
    return out


PASSAGE = "label string, words array<string>, by_idf array<string>, keys array<struct<at int, words array<string>>>, key_words array<string>"


def judged(t: Column, words: Column, hits: Column) -> Column:
    """(label, share) of a passage in a file: the largest share of the passage's words in place at a verified start, or null."""
    rare = F.slice(F.array_intersect(t["by_idf"], hits["w"]), 1, LOOKED_UP)
    postings = F.filter(F.transform(t["words"], lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda p: F.array_contains(rare, p["w"]))
    votes = F.array_sort(F.flatten(F.transform(postings, lambda p: F.transform(F.filter(hits, lambda h: h["w"] == p["w"]), lambda h: h["i"] - p["at"]))))
    # A posting votes once for a start, so that many equal votes in a row are that many postings.
    needed = F.greatest(F.lit(1), F.ceil(F.size(postings) * LEAST_SHARE)).cast("int")
    starts = F.transform(
        F.array(F.struct(votes.alias("votes"), needed.alias("needed"))),
        lambda v: F.array_distinct(F.filter(v["votes"], lambda s, i: F.coalesce(F.get(v["votes"], i + v["needed"] - 1) == s, F.lit(False)))),
    )
    stands = lambda s: F.forall(t["keys"], lambda k: (s + k["at"] >= 0) & (F.slice(words, F.greatest(s + k["at"] + 1, F.lit(1)), F.size(k["words"])) == k["words"]))
    share = lambda s: F.size(F.filter(t["words"], lambda w, i: F.coalesce(F.get(words, s + i) == w, F.lit(False)))) / F.size(t["words"])
    best = F.array_max(F.transform(F.filter(F.flatten(starts), stands), share))
    return F.struct(t["label"].alias("label"), best.alias("share"))


def bases(words: Column, hits: Column) -> Column:
    """Places of the base phrases, as an array of (at, label)."""


    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        same = lambda h: (h["w"] == parts[0]) & (F.slice(words, h["i"] + 1, len(parts)) == F.array(*map(F.lit, parts)))
        return F.transform(F.filter(hits, same), lambda h: F.struct(h["i"].cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase, label) for phrase, label in PHRASES.items()))


def scan(docs: DataFrame) -> DataFrame:
    """Labels each row of docs (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start),
    base_labels, labels (base ones and the method's), score (largest share of a verified passage's words, 1 for a base phrase).
    """
    templates = passages()
    vocabulary = sorted({w for t in templates for w in t["words"]} | {w for p in PHRASES for w in p.split()})
    texts = docs.select("doc_id", F.filter(F.split(lowered(F.coalesce(F.col("text"), F.lit(""))), OUTSIDE), lambda w: w != "").alias("words"))
    licence = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = texts.select("doc_id", "words", licence.alias("hits"))
    # Document frequency of the template words over all documents: one count for each, whatever the input.
    own = texts.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("w"))
    frequency = {r["w"]: r["df"] for r in own.groupBy("w").agg(F.count("*").alias("df")).collect()}
    for t in templates:
        t["by_idf"] = sorted(set(t["words"]), key=lambda w: (frequency.get(w, 0), w))
    index = F.from_json(F.lit(json.dumps(templates)), f"array<struct<{PASSAGE}>>")
    words, hits = F.col("words"), F.col("hits")
    # Only passages whose key phrases' words the file has can be verified.
    likely = F.filter(index, lambda t: F.size(F.array_intersect(t["key_words"], F.col("distinct"))) == F.size(t["key_words"]))
    known = rows.select("doc_id", "words", "hits", F.array_distinct("hits.w").alias("distinct")).select("doc_id", "words", "hits", likely.alias("likely"))
    verified = F.filter(F.transform("likely", lambda t: judged(t, words, hits)), lambda m: m["share"] >= LEAST_SHARE)
    found = known.select("doc_id", F.size("words").cast("long").alias("n_words"), bases(words, hits).alias("base"), verified.alias("own"))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"),
        listed(F.concat("base.label", "own.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("own.share"), F.lit(0.0))).alias("score"),
    )
