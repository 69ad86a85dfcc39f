"""License scans: stretches of text against licence templates by Dice coefficient over word bigrams.

A text is lower-cased, everything but letters a-z and digits becomes one space,
and stretches of it are compared with each template: its lines, its paragraphs,
the whole, and windows of as many words as a template has, laid so that an
anchor word (see ``anchors``) of the text meets the same word of the template.
So a notice is found between other words, over any line breaks, and behind
comment marks.  With a least coefficient t only templates whose number of bigrams lies within
[t / (2 - t), (2 - t) / t] times that of the stretch can reach it; the others
are not looked at.  A text without any of the templates' anchor words can match
none and is passed over.  A stretch counts for the template that it is most like.  All of it is one projection of built-in functions.

Nulls count as empty texts, which match nothing; repeated rows give repeated
results; ties between templates go to the first by name.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._native import let

LEAST_DICE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met:",
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
    ),
}

#: Licences whose notice is part of another's, with that other.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause", "MIT-0": "MIT", "0BSD": "ISC"}
#: Templates of different licences that share this much, by Dice, are told apart by what only one of them has.
FAMILY = 0.6

#: Words too frequent in prose to tell a notice.
FREQUENT = frozenset("a any and at be by file for from in is it may not of on or or so that the this to under use was with you".split())


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    bigrams: tuple[str, ...]


def templates(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Template]:
    out = []
    for name in sorted(texts):
        for text in texts[name]:
            w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
            out.append(Template(name, tuple(w), tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))))
    return out


def required(t: Template, known: list[Template]) -> list[tuple[str, ...]]:
    """What a stretch must name to count for a template: lists of bigrams of which one each must be there.

    Every number that follows a word, as in a version, in that bigram; and for
    each template of another licence that is much like it, every word that the
    other lacks, in any of its bigrams, or every bigram that the other lacks where
    it has all words.  A notice that another one goes on from needs its end.
    """
    own = set(t.bigrams)
    out = [(b,) for b in t.bigrams if b.split()[1].isdigit()]
    for u in known:
        if extended(u, known, t):
            out.append((t.bigrams[-1],))
        elif u.name != t.name and not extended(t, known, u) and 2 * len(own & set(u.bigrams)) >= FAMILY * (len(own) + len(u.bigrams)):
            words = [w for w in dict.fromkeys(t.words) if w not in u.words]
            out += [tuple(b for b in t.bigrams if w in b.split()) for w in words] or [(b,) for b in t.bigrams if b not in u.bigrams]
    return list(dict.fromkeys(out))


def extended(t: Template, known: list[Template], by: Template | None = None) -> list[tuple[str, tuple[str, ...]]]:
    """For each notice (``by``, or all known) that ``t`` goes on from: its last bigram, and the bigrams of ``t`` beyond it.

    A stretch with the first counts for ``t`` only if it has some of the second, and
    one with neither is in doubt: it does not count where the shorter notice is found.
    """
    parts = [u for u in known if PART_OF.get(u.name) == t.name and set(u.bigrams) < set(t.bigrams) and by in (None, u)]
    return [(u.bigrams[-1], tuple(b for b in t.bigrams if b not in u.bigrams)) for u in parts]


def needed(of: list[tuple[str, ...]], least: float) -> int:
    """How many of the required lists a stretch must meet; all of a few."""
    return math.ceil(least * len(of) - 1e-9)


def bounds(size: int, least: float) -> tuple[float, float]:
    """The numbers of bigrams a stretch can have to reach ``least`` with a template of ``size``."""
    return size * least / (2 - least), size * (2 - least) / least


def anchors(t: Template, least: float) -> list[str]:
    """Words of a template of which every stretch that reaches ``least`` with it has at least one.

    Such a stretch shares at least least / (2 - least) of the template's bigrams.
    Words are taken, the longest first and frequent ones last, until the bigrams
    without any of them are fewer than that.
    """
    need = math.ceil(len(t.bigrams) * least / (2 - least) - 1e-9)
    taken: list[str] = []
    for word in sorted({w for b in t.bigrams for w in b.split()}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if sum(not set(b.split()) & set(taken) for b in t.bigrams) < need:
            break
        taken.append(word)
    return taken


def windows(known: list[Template], least: float) -> list[tuple[str, int, int]]:
    """Each anchor word with the words before it in its template and the template's number of words, without repeats."""
    return sorted({(w, at, len(t.words)) for t in known for a in [set(anchors(t, least))] for at, w in enumerate(t.words) if w in a})


def _best(stretch: Column, known: list[Template], least: float) -> Column:
    """The best template of a normalised stretch as (dice, license); null below ``least``."""
    w = F.split(F.btrim(stretch), " +")
    low = min(bounds(len(t.bigrams), least)[0] for t in known)

    def judged(b: Column) -> Column:
        size = F.size(b)
        found = []
        for i, t in enumerate(known):
            lo, hi = bounds(len(t.bigrams), least)
            both = F.size(F.array_intersect(b, F.array(*map(F.lit, t.bigrams))))
            dice = 2.0 * both / (size + F.lit(len(t.bigrams)))
            must = required(t, known)
            named = sum((F.arrays_overlap(b, F.array(*map(F.lit, x))).cast("int") for x in must), start=F.lit(0)) >= needed(must, least)
            sure = F.lit(True)
            for end, beyond in extended(t, known):
                sure &= F.arrays_overlap(b, F.array(*map(F.lit, beyond)))
                named &= ~F.array_contains(b, end) | sure
            found.append(
                F.when(
                    size.between(lo, hi) & (dice >= least) & named,
                    F.struct(dice.alias("dice"), F.lit(-i).alias("order"), F.lit(t.name).alias("license"), sure.alias("sure")),
                )
            )
        return F.greatest(*found)

    pairs = let(w, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.concat_ws(" ", F.get(x, i - 1), F.get(x, i))))
    return F.when(F.size(w) - 1 >= low, let(F.array_distinct(pairs), judged))


def _whole_only(found: Column) -> Column:
    """Matches without those of licences that are part of another one found for sure, and without doubtful ones of that other where the part is found."""
    sure, named = F.filter(found, lambda g: g["sure"])["license"], found["license"]

    def dropped(f: Column) -> list[Column]:
        part = [(f["license"] == a) & F.array_contains(sure, b) for a, b in PART_OF.items()]
        return part + [(f["license"] == b) & ~F.array_contains(sure, b) & F.array_contains(named, a) for a, b in PART_OF.items()]

    return F.filter(found, lambda f: ~reduce(Column.__or__, dropped(f)))


def licenses(docs: DataFrame, least: float = LEAST_DICE, texts: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``doc_id, licenses, best_dice, n_licenses`` for each row of ``docs(doc_id, text)``; no match: null, null, 0."""
    known = templates(texts)
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "[^a-z0-9\\n]+", " ")

    laid = windows(known, least)
    specs = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(at).alias("at"), F.lit(n).alias("n")) for w, at, n in laid))
    anchored = F.array(*(F.lit(w) for w in sorted({w for w, _, _ in laid})))

    def around(w: Column) -> Column:
        def of_hit(h: Column) -> Column:
            fits = F.filter(specs, lambda s: s["word"] == h["word"])
            start = lambda s: F.greatest(h["i"] - s["at"], F.lit(0))
            return F.transform(fits, lambda s: F.array_join(F.slice(w, start(s) + 1, s["n"] - (start(s) - (h["i"] - s["at"]))), " "))

        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: F.array_contains(anchored, h["word"]))
        return F.flatten(F.transform(hits, of_hit))

    def stretches(t: Column) -> Column:
        paragraphs = F.transform(F.split(t, "\\n *\\n", -1), lambda p: F.translate(p, "\n", " "))
        whole = F.translate(t, "\n", " ")
        return F.array_distinct(F.concat(F.split(t, "\\n", -1), paragraphs, F.array(whole), let(F.split(F.btrim(whole), " +"), around)))

    words = "|".join(sorted({w for t in known for w in anchors(t, least)}))
    maybe = F.coalesce(F.col("text").rlike(f"(?i)(?<![A-Za-z0-9])(?:{words})(?![A-Za-z0-9])"), F.lit(False))
    found = F.filter(F.transform(let(plain, stretches), lambda s: _best(s, known, least)), lambda x: x.isNotNull())
    nothing = F.array().cast("array<struct<dice:double,order:int,license:string,sure:boolean>>")
    found = F.when(maybe, let(found, _whole_only)).otherwise(nothing)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    return out.select(
        "doc_id",
        F.when(F.size("found") > 0, F.array_join(names, ",")).alias("licenses"),
        F.array_max(F.transform("found", lambda x: x["dice"])).alias("best_dice"),
        F.size(names).cast("long").alias("n_licenses"),
    )
