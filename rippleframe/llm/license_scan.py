"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a run of consecutive lines, blank ones left out, so that notices count however they are wrapped. Normalised,
it is its words of ASCII letters, digits and dots within numbers, in lower case. Its bigrams are distinct pairs of
neighbouring words. With a Dice coefficient of at least `at`, the number of a passage's bigrams lies within at / (2 - at)
and (2 - at) / at of the template's; so a passage has no more words than the largest template allows. It also shares
enough bigrams that it must hold one of the template's rarest ones, its marks: only runs about a line with a mark are
compared. Of passages that match and overlap, one counts that no other beats: by Dice, then fewer lines, then earlier.

All work on executors is DataFrame operations; one pass, no shuffle of texts. Work is linear in the lines of a text: a line
looks at the passages that start within `longest` lines of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = 0.8
#: Notices by which works name their licence, and opening terms of some. A licence may have several texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words_of(template: str) -> list[str]:
    return re.findall(_WORD, template.lower())


def bigrams_of(template: str) -> set[str]:
    w = words_of(template)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def marks(bigrams: set[str], at: float) -> list[str]:
    """Fewest bigrams of a template such that every passage with a Dice coefficient of at least `at` has one of them.

    A passage shares at least at / (2 - at) of the template's bigrams, so one of any more than the others.
    """
    need = -(-round(1e9 * at / (2 - at) * len(bigrams)) // 10**9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - need + 1]


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x evaluated once a row: a column that is read in a lambda may be put in there and made for each element."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(templates: dict[str, str | list[str]]) -> list[tuple[str, set[str]]]:
    """(name, bigrams) of every text of every template, by name."""
    return [(name, bigrams_of(t)) for name, own in sorted(templates.items()) for t in ([own] if isinstance(own, str) else own)]


def most_words(templates: dict[str, str | list[str]], at: float) -> int:
    """Words of the longest passage."""
    return int(max(len(b) for _, b in texts_of(templates)) * (2 - at) / at + 1e-9) + 1


def scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, at: float = AT, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, licenses (sorted names), n_passages, best_license, best_dice.

    templates: one text or several by name; whole licences may be given. n_passages counts the passages that match and
    that no overlapping one beats; a passage's template is the nearest, ties go to the first name. A document without a
    match, such as an empty or null text, has no names, 0 passages and null for the best. Repeated rows and null ids are
    scanned row by row; other columns are not read. An empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    sets = texts_of(templates)
    longest = most_words(templates, at)
    least = min(len(b) for _, b in sets) * at / (2 - at)
    # A passage may match only if it holds a mark, whatever stands between its words.
    alternatives = sorted({m for _, b in sets for m in marks(b, at)})
    anchor = "|".join("[^a-z0-9]+".join(map(re.escape, m.split(" "))) for m in alternatives)
    # Nothing that has no mark is split into lines.
    low = _lower(F.coalesce(docs[text], F.lit("")))
    rows = docs.select(docs[id_column].alias("id"), F.when(low.rlike(anchor), low).alias("low"))
    rows = rows.withColumn("lines", F.filter(F.split("low", "\n"), lambda x: x.rlike("[a-z0-9]")))
    n = F.size("lines")
    marked = _let(F.col("lines"), lambda lines: F.filter(F.sequence(F.lit(1), n), lambda k: F.concat_ws("\n", F.element_at(lines, k), F.get(lines, k)).rlike(anchor)))
    # A line of more than `longest` words is in no passage; one word more tells so.
    own_words = F.transform("lines", lambda x: F.slice(F.regexp_extract_all(x, F.lit(f"({_WORD})"), F.lit(1)), 1, longest + 1))
    rows = rows.withColumn("marked", F.when(n > 0, marked)).withColumn("words", F.when(F.size("marked") > 0, own_words)).drop("low", "lines")

    # Each line that may start a passage, in order, once: with the first marked line from there on.
    def starts_before(k: Column, before: Column) -> Column:
        first = F.greatest(k - longest + 1, before + 1)
        return F.transform(F.sequence(first, k), lambda i: F.struct(i.alias("i"), k.alias("k")))

    starts = _let(F.col("marked"), lambda m: F.flatten(F.transform(m, lambda k, at: starts_before(k, F.coalesce(F.get(m, at - 1), F.lit(0))))))

    def upto(lines: Column) -> Column:
        """Words up to each line, as long as they are no more than `longest`."""
        none = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("upto"))

        def add(a: Column, line: Column) -> Column:
            total = a["sum"] + F.size(line)
            return F.struct(total.alias("sum"), F.when(total <= longest, F.concat(a["upto"], F.array(total))).otherwise(a["upto"]).alias("upto"))

        return F.reduce(lines, none, add)["upto"]

    ahead = _let(F.col("words"), lambda words: F.transform(starts, lambda s: F.struct(s["i"].alias("i"), s["k"].alias("k"), F.slice(words, s["i"], longest).alias("lines"))))
    ahead = F.transform(ahead, lambda s: F.struct(s["i"].alias("i"), s["k"].alias("k"), F.flatten(s["lines"]).alias("w"), upto(s["lines"]).alias("upto")))
    ahead = F.filter(ahead, lambda s: F.size(s["upto"]) > s["k"] - s["i"])
    pairs = lambda w: F.zip_with(F.slice(w, 1, longest - 1), F.slice(w, 2, longest - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    ahead = F.transform(ahead, lambda s: F.struct(s["i"].alias("i"), s["k"].alias("k"), pairs(s["w"]).alias("pairs"), s["upto"].alias("upto")))

    def near(b: Column, i: Column, j: Column) -> Column:
        found = []
        for name, own in sets:
            m = F.size(b)
            inside = (m >= at / (2 - at) * len(own) - 1e-9) & (m <= (2 - at) / at * len(own) + 1e-9)
            shared = F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in sorted(own)])))
            dice = F.when(inside, 2.0 * shared / (m + len(own)))
            found.append(F.when(dice >= at, F.struct((-dice).alias("far"), F.lit(name).alias("name"))))
        # Sorted as passages beat each other: by Dice, then fewer lines, then earlier.
        return F.transform(F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())), lambda x: F.struct(x["far"].alias("far"), (j - i).alias("more"), i.alias("i"), j.alias("j"), x["name"].alias("name")))

    def hits_from(s: Column) -> Column:
        ends = F.filter(F.sequence(s["k"] - s["i"] + 1, F.size(s["upto"])), lambda x: F.element_at(s["upto"], x) > least - 1e-9)
        runs = F.transform(ends, lambda x: F.struct((s["i"] + x - 1).alias("j"), F.array_distinct(F.slice(s["pairs"], 1, F.element_at(s["upto"], x) - 1)).alias("own")))
        return F.flatten(F.transform(runs, lambda r: F.slice(near(r["own"], s["i"], r["j"]), 1, 1)))

    found = F.transform(ahead, lambda s: F.struct(s["i"].alias("i"), hits_from(s).alias("hits")))
    found = F.filter(found, lambda s: F.size(s["hits"]) > 0)
    rows = rows.withColumn("starts", F.transform(found, lambda s: F.struct(s["i"].alias("i"), s["hits"].alias("hits"), F.array_min(s["hits"]).alias("best"))))

    # Passages from one line overlap, so only the best of each can win. It meets the bests of the lines within it, and what
    # reaches it from earlier lines: at most `longest` lines on either side.
    def wins(starts: Column, s: Column, at: Column) -> Column:
        earlier = F.slice(starts, F.greatest(F.lit(1), at + 1 - longest), F.least(at, F.lit(longest)))
        later = F.slice(starts, at + 2, longest)
        return ~F.exists(earlier, lambda b: F.exists(b["hits"], lambda g: (g["j"] >= s["i"]) & (g < s["best"]))) & ~F.exists(later, lambda b: (b["i"] <= s["best"]["j"]) & (b["best"] < s["best"]))

    rows = rows.withColumn("hits", _let(F.col("starts"), lambda starts: F.transform(F.filter(starts, lambda s, at: wins(starts, s, at)), lambda s: s["best"])))
    best = F.array_min(F.transform("hits", lambda h: F.struct(h["far"], h["name"])))
    names = F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), F.array().cast("array<string>"))
    return rows.select(
        "id", names.alias("licenses"), F.greatest(F.size("hits"), F.lit(0)).cast("long").alias("n_passages"), best["name"].alias("best_license"), (-best["far"]).alias("best_dice")
    )
