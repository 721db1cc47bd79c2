"""Licence notices in documents by a positional index of rare words, with DataFrame functions only.

1. The index holds the rarest words of each notice with their positions in it. How rare a licence word is comes from the
   number of all documents that hold it.
2. Every document is looked up by these words, so no notice crowds out another. Each occurrence, less the word's position
   in a notice, says where the notice would begin; beginnings on which several words agree are the candidates.
3. A candidate counts if a mandatory phrase of the notice stands in the document at the place the beginning asks for,
   give or take ``slack`` words. Only candidates are asked for their phrase.

The score is the largest share of a notice's rarest words (by their inverse document frequency) that agree; a document with
only a plain mention ("mit license") has 0.5, one without both 0. Notices, their words and the frequencies of those words
are of fixed number; nothing else is broadcast or collected.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows have a result each; rows
without id too; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelattice.llm.common import lower_ascii, text_of
from tradelattice.session import stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Plain mentions and their labels. Fixed values.
MENTIONS = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    text: str
    key: str  # the mandatory phrase


#: Public notices of licences, by label. Fixed values.
NOTICES = {
    "agpl-3.0": Notice("licensed under the GNU Affero General Public License, version 3", "gnu affero general public license"),
    "apache-2.0": Notice("Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    "bsd": Notice("Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
                  " the following conditions are met", "redistribution and use in source and binary forms"),
    "cc-by-4.0": Notice("This work is licensed under a Creative Commons Attribution 4.0 International License",
                        "creative commons attribution 4 0 international"),
    "cc-by-nc-4.0": Notice("Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    "cc-by-sa-4.0": Notice("Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    "gpl-2.0": Notice("licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    "gpl-3.0": Notice("This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    "isc": Notice("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
                  " granted", "permission to use copy modify and or distribute this software"),
    "lgpl": Notice("licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    "mit-grant": Notice("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                        " documentation files", "permission is hereby granted free of charge"),
    "mit-release": Notice("Released under the MIT License", "released under the mit license"),
    "mpl-2.0": Notice("subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    "unlicense": Notice("This is free and unencumbered software released into the public domain", "free and unencumbered software"),
}


#: Further usual forms, by label. Fixed values.
HEADERS = [
    *((f"gpl-{v}.0", Notice("under the terms of the GNU General Public License as published by the Free Software Foundation, either"
                            f" version {v} of the License", "gnu general public license as published by the free software foundation"
                            f" either version {v}")) for v in (2, 3)),
    ("lgpl", Notice("under the terms of the GNU Library General Public License", "gnu library general public license")),
    ("cc-by-4.0", Notice("Licensed under CC BY 4.0", "cc by 4 0")),
    ("cc-by-nc-4.0", Notice("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
                            "creative commons attribution noncommercial 4 0 international")),
    ("cc-by-sa-4.0", Notice("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                            "creative commons attribution sharealike 4 0 international")),
    *((label, Notice(f"SPDX-License-Identifier: {name}", f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}"))
      for label, name in [
          ("agpl-3.0", "AGPL-3.0"), ("apache-2.0", "Apache-2.0"), ("bsd", "BSD"), ("cc-by-4.0", "CC-BY-4.0"), ("cc-by-nc-4.0", "CC-BY-NC-4.0"),
          ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("isc", "ISC"), ("lgpl", "LGPL"), ("mit", "MIT"),
          ("mpl-2.0", "MPL-2.0"), ("unlicense", "Unlicense")]),
]

#: Whole notices of licences, by label. Fixed values.
WHOLE = [
    ("mit", Notice(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included"
        " in all copies or substantial portions of the Software.",
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software")),
    ("apache-2.0", Notice(
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under"
        " the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "you may not use this file except in compliance with the license")),
    ("bsd", Notice(
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in"
        " the documentation and/or other materials provided with the distribution.",
        "redistributions of source code must retain the above copyright notice")),
    ("isc", Notice(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies.",
        "provided that the above copyright notice and this permission notice appear in all copies")),
    ("mpl-2.0", Notice(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "if a copy of the mpl was not distributed with this file")),
    ("unlicense", Notice(
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a"
        " compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "anyone is free to copy modify publish use compile sell or distribute this software")),
    ("zlib", Notice(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any"
        " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely",
        "in no event will the authors be held liable for any damages arising from the use of this software")),
    ("bsl-1.0", Notice("Boost Software License - Version 1.0 - August 17th, 2003", "boost software license version 1 0")),
]

#: All forms: (label, notice). Forms are told apart by their place in the list.
FORMS = [*NOTICES.items(), *HEADERS, *WHOLE]


@dataclass(frozen=True)
class Settings:
    """``lookups`` rarest words a notice, without words of more than ``common`` of the documents, and the ``agreeing`` rarest of
    its phrase. ``agreeing`` words must say the same beginning, with ``least_share`` of the notice's rarity."""

    lookups: int = 8
    common: float = 0.1
    agreeing: int = 2
    least_share: float = 0.3
    slack: int = 2


def notice_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


VOCABULARY = sorted({w for _, n in FORMS for w in notice_words(n.text)})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Places where the phrase's words stand one after the other."""
    there = lambda i: reduce(Column.__and__, (F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase)))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), there)
    return F.when(F.array_contains(words, phrase[-1]) & F.array_contains(words, phrase[0]), places).otherwise(F.array().cast("array<int>"))


def labelled_starts(words: Column, phrase: list[str], label: str) -> Column:
    return F.transform(phrase_starts(words, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def lookup_words(notice: Notice, docs: int, counts: dict[str, int], settings: Settings) -> list[str]:
    """The words by which a notice is looked up: the rarest of its mandatory phrase, so that no text with the phrase lacks them,
    and the rarest of all its words."""
    rare = inverse(docs, counts)
    rarest = lambda text: sorted(sorted(set(notice_words(text))), key=lambda w: -rare[w])
    sure = rarest(notice.key)[:settings.agreeing]
    return sure + [w for w in rarest(notice.text)[:settings.lookups] if w not in sure and counts.get(w, 0) <= settings.common * docs]


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each licence word: as many numbers as there are licence words."""
    held = docs.select(F.explode(F.array_append(F.array_intersect(words_of(text_of()), strings(VOCABULARY)), "")).alias("word"))
    counts = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def inverse(docs: int, counts: dict[str, int]) -> dict[str, float]:
    import math

    return {w: math.log((docs + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in VOCABULARY}


def fixed_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of a few literal rows."""
    literal = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))
    return spark.range(1).select(F.inline(literal))


@dataclass(frozen=True)
class Index:
    """The rarest words of the notices: (form, word, place, part of the form's rarity)."""

    postings: list[tuple[int, str, int, float]]

    @classmethod
    def of(cls, docs: int, counts: dict[str, int], settings: Settings) -> Index:
        rare, postings = inverse(docs, counts), []
        for form, (_, notice) in enumerate(FORMS):
            looked_up = lookup_words(notice, docs, counts, settings)
            whole = sum(rare[w] for w in looked_up)
            postings += [(form, w, k, rare[w] / whole) for k, w in enumerate(notice_words(notice.text)) if w in looked_up]
        return cls(postings)

    @property
    def words(self) -> list[str]:
        return sorted({word for _, word, _, _ in self.postings})


def with_hits(docs: DataFrame, index: Index) -> DataFrame:
    """A row per document with its words, the places of plain mentions, and those of words of the index."""
    rows = docs.select("doc_id", words_of(text_of()).alias("words"))
    mentions = [labelled_starts(F.col("words"), p.split(), label) for p, label in MENTIONS.items()]
    nothing = F.array().cast("array<struct<at:int,label:string>>")
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(strings(index.words), x["word"]))
    return rows.select(
        "doc_id", "words", F.when(F.array_contains("words", "license"), F.concat(*mentions)).otherwise(nothing).alias("mentions"), hits.alias("hits"))


def candidates(scanned: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """(row, form, begin, share) of the beginnings of notices on which enough words of the index agree."""
    postings = F.broadcast(fixed_rows(scanned.sparkSession, index.postings, ["form", "word", "place", "part"]))
    return (
        scanned.select("row", F.explode("hits").alias("hit")).select("row", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
        .join(postings, "word").select("row", "form", (F.col("at") - F.col("place")).alias("begin"), "word", "part")
        .groupBy("row", "form", "begin", "word").agg(F.max("part").alias("part"))
        .groupBy("row", "form", "begin").agg(F.sum("part").alias("share"), F.count(F.lit(1)).alias("agreeing"))
        .where((F.col("agreeing") >= settings.agreeing) & (F.col("share") >= settings.least_share)).drop("agreeing")
    )


def proven(found: DataFrame, scanned: DataFrame, settings: Settings) -> DataFrame:
    """The candidates, with their label, whose mandatory phrase stands about where their beginning asks for it."""
    rows = []
    for form, (label, notice) in enumerate(FORMS):
        words, key = notice_words(notice.text), notice_words(notice.key)
        rows.append((form, label, next(k for k in range(len(words)) if words[k:k + len(key)] == key), " ".join(key), len(key)))
    phrases = F.broadcast(fixed_rows(found.sparkSession, rows, ["form", "label", "key_place", "phrase", "phrase_words"]))
    at = F.col("begin") + F.col("key_place")
    there = lambda k: (at + k >= 0) & (
        F.array_join(F.slice("words", F.greatest(at + k, F.lit(0)) + 1, F.col("phrase_words")), " ") == F.col("phrase"))
    held = reduce(Column.__or__, (there(k) for k in range(-settings.slack, settings.slack + 1)))
    return found.join(phrases, "form").join(scanned.select("row", "words"), "row").where(held).select("row", "form", "label", "begin", "share")


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row a document.

    ``spans``: label, first word and share of each notice found.
    """
    index = Index.of(*frequencies(docs), settings)
    rows = with_hits(docs, index)
    # One word of the index alone can't agree with another; such documents are not looked up and their words not kept.
    several = F.size(F.array_distinct(F.transform("hits", lambda x: x["word"]))) >= settings.agreeing
    scanned = stage(
        rows.select(
            "doc_id", F.uuid().alias("row"), F.size("words").cast("long").alias("n_words"), "mentions",
            F.when(several, F.col("hits")).alias("hits"), F.when(several, F.col("words")).alias("words"),
        ), "scanned",
    )
    looked_up = scanned.where("hits is not null")
    met = proven(stage(candidates(looked_up, index, settings), "candidates"), looked_up, settings)
    best = met.groupBy("row", "label").agg(F.max(F.struct("share", (-F.col("begin")).alias("late"))).alias("best"))
    spans = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "label", (-F.col("best.late")).cast("long").alias("first_word"), F.least(F.col("best.share"), F.lit(1.0)).alias("share")))).alias("spans"))
    base = F.array_distinct(F.transform("mentions", lambda x: x["label"]))
    places = F.transform("mentions", lambda x: x["at"].cast("long"))
    own = F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))
    best_share = F.array_max(F.transform("spans", lambda x: x["share"]))
    return scanned.select("doc_id", "row", "n_words", "mentions").join(spans, "row", "left").select(
        "doc_id", "n_words", F.size("mentions").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(best_share, F.when(F.size("mentions") > 0, 0.5), F.lit(0.0)).cast("double").alias("score"), "spans",
    )
