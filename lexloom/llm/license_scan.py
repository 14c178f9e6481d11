"""License scan by a positional rare-token index, in DataFrame functions alone.

The templates are short public licence notices.  A word's weight is its inverse document frequency
over the scanned documents themselves; of each template the RARE words of highest weight are its
seeds, with their positions as postings.  A file's seed words are looked up in the postings; each hit
(word at i, posting at p of template t) votes for t starting at i - p.  Votes are sorted; a start with votes from two
different postings, or from all of a shorter template's, is a candidate; it stands if the template's
mandatory key phrases are found word by word in their places.  Its score is the weight of
the template's words that are in place there, as a share of the whole template's.  Beside this the
base phrases are counted in every file, whatever the index says.

The whole runs in projections over one scan each (document frequencies, then files), without
exchange of texts; what is broadcast are the templates' constants.  Null text is empty: 0
words.  Repeated rows are scanned alike, ties of weight go by the word, an empty table gives no rows,
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice, and the key phrases that a match must hold.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "any person obtaining a copy"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms", "with or without modification"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("proprietary", "all rights reserved do not redistribute", ["all rights reserved"]),
]

RARE = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BREAK), "")


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many documents each of these words stands, and the number of documents."""
    some = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    # One count a word, folded map-side: the driver gets as many rows as the vocabulary has words.
    counts = docs.select(F.explode(F.concat(some, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counts}
    total = found.pop("", 0)
    return found, total


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase, as a sorted array."""
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())

    def stands(k: int):
        return lambda i: F.get(words, i + k) == phrase[k]

    for k in range(1, len(phrase)):
        starts = F.filter(starts, stands(k))
    return starts


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    seen, total = document_frequency(docs, vocabulary)
    weight = {w: math.log((1 + total) / (1 + seen.get(w, 0))) + 0.01 for w in vocabulary}
    postings: dict[str, list[tuple[int, int]]] = {}
    votes_needed = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        own = notice.split()
        seeds = sorted(set(own), key=lambda w: (-weight[w], w))[:RARE]
        count = 0
        for p, w in enumerate(own):
            if w in seeds:
                postings.setdefault(w, []).append((t, p))
                count += 1
        votes_needed.append(min(2, count))
    pair = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[pair(t, p) for t, p in postings[w]]))])
    seeds = F.array(*map(F.lit, sorted(postings)))
    words = F.col("words")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("rare", F.array_intersect(words, seeds))
    none = F.array().cast("array<int>")
    for i, phrase in enumerate(BASE):
        parts = phrase.split()
        rows = rows.withColumn(f"base{i}", F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), _places(words, parts)).otherwise(none))
    # Hits only where two seeds stand at all; elsewhere no word is looked up.
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(F.col("rare"), w), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    empty_hits = F.array().cast("array<struct<w:string,i:int>>")
    rows = rows.withColumn("hits", F.when(F.size("rare") >= 2, hits).otherwise(empty_hits))
    # A vote is one number, the start times the number of templates plus the template.
    count = len(TEMPLATES)
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h["w"]), lambda p: (h["i"] - p["p"]).cast("long") * count + p["t"])))
    rows = rows.withColumn("starts", F.sort_array(F.filter(votes, lambda c: c >= 0)))
    # Sorted votes: a start with two has its like beside it, so a file of n hits costs n log n.
    alone = F.array(*[F.lit(n < 2) for n in votes_needed])
    enough = F.filter("starts", lambda c, i: F.get(alone, (c % count).cast("int")) | F.coalesce(F.get("starts", i + 1) == c, F.lit(False)))
    rows = rows.withColumn("starts", F.array_distinct(enough))

    def verified(t: int) -> Column:
        """Best score of template t over its candidate starts; null without a match."""
        _, notice, phrases = TEMPLATES[t]
        own = notice.split()
        whole = sum(weight[w] for w in own)

        def score(c: Column) -> Column:
            at = ((c - t) / count).cast("int")
            held = F.lit(True)
            for phrase in phrases:
                key = phrase.split()
                place = next(p for p in range(len(own)) if own[p : p + len(key)] == key)
                for k, w in enumerate(key):
                    held = held & (F.get(words, at + (place + k)) == w)
            share = sum((F.when(F.get(words, at + p) == w, F.lit(weight[w] / whole)).otherwise(0.0) for p, w in enumerate(own)), F.lit(0.0))
            return F.when(held, F.least(share, F.lit(1.0)))

        return F.array_max(F.transform(F.filter("starts", lambda c: c % count == t), score))

    scores = F.when(F.size("starts") > 0, F.array(*[verified(t) for t in range(len(TEMPLATES))])).otherwise(F.array().cast("array<double>"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *[f"base{i}" for i in range(len(BASE))], scores.alias("scores"))
    bases = F.concat(*[f"base{i}" for i in range(len(BASE))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{i}") > 0, label) for i, label in enumerate(BASE.values())]))
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    more = F.array_compact(F.transform("scores", lambda s, i: F.when(s.isNotNull(), F.get(names, i))))
    rows = rows.withColumn("bases", bases).withColumn("own", base_labels).withColumn("more", more)
    tidy = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.array_min("bases").cast("long").alias("first_word"),
        F.array_max("bases").cast("long").alias("last_word"),
        tidy(F.col("own")).alias("base_labels"),
        tidy(F.concat("own", "more")).alias("labels"),
        F.when(F.size("bases") > 0, 1.0).otherwise(F.coalesce(F.array_max("scores"), F.lit(0.0))).alias("score"),
    )
