"""License scan (operator 1) by a positional rare-token index, in SQL expressions only.

Document frequencies of the template words over all documents give their idf.
Each template is indexed under the two rarest words of its key phrase, with their
offsets. A file's words of highest idf among those are looked up: a template is
laid where the places of both of its words agree on its start. There the key
phrase has to stand in full, and the idf weight of the template's words found
within a few places of their own is the score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label, template, key phrase (a part of the template that has to stand in full), and whether it is a base phrase.
TEMPLATES: list[tuple[str, str, str, bool]] = [
    ("gpl", "gnu general public license", "gnu general public license", True),
    ("apache", "apache license", "apache license", True),
    ("cc-by", "cc by", "cc by", True),
    ("mit", "mit license", "mit license", True),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2", False),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3", False),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2", False),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3", False),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license", False),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0", False),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may not use this file except in compliance with the license", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd", False),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal", False),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge", False),
    ("mit-notice", "released under the mit license", "under the mit license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution and use in source and binary forms", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute", False),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license", False),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable", False),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software", False),
]
#: Places by which a template word may be off its own.
SHIFT = 2
#: What parts words, before and after lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many of them each word stands. One row a word comes back."""
    held = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), GAPS), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def index(n: int, frequency: dict[str, int], templates=TEMPLATES) -> list[dict]:
    """The postings: each template under the two rarest words of its key phrase, with its words' shares of idf weight."""
    idf = lambda w: math.log((2 + n) / (1 + frequency.get(w, 0)))
    out = []
    for label, text, key, base in templates:
        words, phrase = text.split(), key.split()
        start = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        weight = [idf(w) for w in words]
        rare = sorted(range(len(phrase)), key=lambda i: (-idf(phrase[i]), i))
        first = rare[0]
        second = next((i for i in rare if phrase[i] != phrase[first]), rare[-1])
        out.append({"a": phrase[first], "i": first, "b": phrase[second], "j": second, "w": words, "g": [x / sum(weight) for x in weight], "k": start, "n": len(phrase), "label": label, "base": base})
    return out


def postings_column(postings: list[dict]) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.array(*[F.struct(*[value(v).alias(k) for k, v in p.items()]) for p in postings])


#: Starts of a template's key phrase on which the places of both its words agree.
STARTS = "array_intersect(transform(filter(places, x -> words[x] = p.a), x -> x - p.i), transform(filter(places, x -> words[x] = p.b), x -> x - p.j))"
#: Whether the phrase stands in full at a start.
WHOLE = "slice(words, s + 1, p.n) = slice(p.w, p.k + 1, p.n)"
#: Whether the template's word q stands near its place.
NEAR = f"array_contains(slice(words, greatest(1, s - p.k + q + 1 - {SHIFT}), least({2 * SHIFT + 1}, s - p.k + q + {SHIFT + 1})), p.w[q])"
SCORE = f"if(p.base, 1D, aggregate(sequence(0, size(p.w) - 1), 0D, (sum, q) -> sum + if(s - p.k + q >= -{SHIFT}, if({NEAR}, p.g[q], 0D), 0D)))"


def scan_licenses(docs: DataFrame, least: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """Find license phrases in every whole text.

    Returns doc_id, n_words, n_base (places where a base phrase stands),
    first_word and last_word (their smallest and largest start, else null),
    base_labels, labels (with those of other templates whose key phrase stands
    and whose score is ``least`` or more), score (the best of any such place,
    else 0) and places (label, start and score of each, in order).

    Null and empty texts have no words, so no places. Texts of any length are scanned
    whole. Equally rare words of a key phrase go by their order in it. Repeated rows are scanned
    each on its own, null doc_ids are kept, an empty table gives no rows, and
    further columns are ignored.
    """
    vocabulary = sorted({w for _, text, _, _ in templates for w in text.split()})
    postings = index(*word_frequencies(docs, vocabulary), templates)
    rare = sorted({w for p in postings for w in (p["a"], p["b"])})
    lowered = F.lower("text")
    may = lowered.contains(postings[0]["a"])
    for word in sorted({p["a"] for p in postings[1:]}):
        may = may | lowered.contains(word)
    words = F.when(may, F.filter(F.split(F.translate("text", UPPER, LOWER), GAPS), lambda w: w != ""))
    found = docs.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(words, F.array().cast("array<string>")).alias("words"),
    )
    # the file's words of the index, and of the postings those that it may hold
    found = found.withColumn("held", F.array_intersect("words", F.array(*map(F.lit, rare))))
    found = found.withColumn("live", F.when(F.size("held") > 1, F.filter(postings_column(postings), lambda p: F.array_contains("held", p["a"]) & F.array_contains("held", p["b"]))))
    none = "cast(array() as array<int>)"
    found = found.withColumn("places", F.expr(f"if(size(live) > 0, filter(sequence(0, size(words) - 1), x -> array_contains(held, words[x])), {none})"))
    hits = f"""flatten(transform(live, p -> transform(filter({STARTS}, s -> s >= 0 and {WHOLE}), s ->
        named_struct('start', cast(s as bigint), 'label', p.label, 'base', p.base, 'score', {SCORE}))))"""
    found = found.select("doc_id", "n_words", F.coalesce(F.expr(f"if(size(places) > 0, {hits}, null)"), F.expr("cast(array() as array<struct<start:bigint,label:string,base:boolean,score:double>>)")).alias("all"))
    found = found.withColumn("places", F.expr(f"array_sort(filter(all, h -> h.base or h.score >= {least}))"))
    return found.select(
        "doc_id", "n_words",
        F.expr("cast(size(filter(places, h -> h.base)) as bigint)").alias("n_base"),
        F.expr("array_min(transform(filter(places, h -> h.base), h -> h.start))").alias("first_word"),
        F.expr("array_max(transform(filter(places, h -> h.base), h -> h.start))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(filter(places, h -> h.base), h -> h.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(places, h -> h.label))), ',')").alias("labels"),
        F.expr("round(least(1D, coalesce(array_max(transform(places, h -> h.score)), 0D)), 9)").alias("score"),
        "places",
    )
