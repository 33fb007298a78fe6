"""License texts in documents by MinHash bands over overlapping windows, in DataFrame functions only.

1. Documents and templates are runs of words, line feeds being blanks, and of word shingles. Shingles that no template
   has cannot be in a band that a template has; they are dropped before windows are made.
2. Windows over the places of the shingles overlap by two thirds, in a ladder of sizes: each template has a size of
   about its own length, so that its text lies whole in some window of that size.
3. A window and a template of its size meet if they agree in a band: the smallest value of one hash function over their
   shingles. A window that holds 80 % of a template has a Jaccard similarity to it of 0.38 or more; with 40 bands of one
   row all are missed with a probability below 1e-8.
4. The exact share of the template's shingles inside that window decides; what is scattered over the text does not add up.
5. Every place of the text goes to the template with the highest share around it, in a run no longer than the template;
   the longer one of equals. A template that wins no more than half of its places in a window has another license's
   wording there and is no match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import SPACE_CLASS, cut, let

#: Names and texts of public licenses and their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work."),
]
#: Words of a shingle, bands of a sketch (of one row each), and by how much the window sizes grow.
WORDS, BANDS, GROWTH = 3, 40, 1.25
#: Template shingles that are broadcast (32 MB); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def _hashes(text: Column) -> Column:
    """A hash of every word of a text, without regard to case and outer punctuation."""
    words = F.transform(F.split(F.lower(text), SPACE_CLASS + "+"), lambda w: F.btrim(w, F.lit("\"'`.,;:()[]{}*#/-")))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(hashes: Column, n: int) -> Column:
    """Every run of ``n`` word hashes; none if there are fewer."""
    first = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    return F.transform(first, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, n))))


def shingled(df: DataFrame, key: Column, text: Column, n: int) -> DataFrame:
    """(key, s): the shingles of each text in order; the whole text is one if it has fewer words."""
    value = _hashes(F.coalesce(text.cast("string"), F.lit("")))
    whole = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return df.select(key.alias("key"), let(value, lambda h: F.when(F.size(h) < n, whole(h)).otherwise(_shingles(h, n))).alias("s"))


def window_size(n: Column) -> Column:
    """The step of the ladder of sizes that a template of ``n`` shingles has: the next power of GROWTH."""
    return F.ceil(F.log(n.cast("double")) / math.log(GROWTH) - 1e-9).cast("int")


def windows(held: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, size, window, pos, x): the shingles ``held`` (key, pos, x) in every window that covers their place. Windows of
    a size c are one and a half c long and start every half c."""
    size = F.explode(F.array(*(F.lit(c) for c in sizes))).alias("size")
    step = F.greatest(F.ceil(F.pow(F.lit(GROWTH), F.col("size")) / 2), F.lit(1))
    placed = held.select("key", "pos", "x", size).withColumn("__w", F.floor(F.col("pos") / step))
    return placed.select("key", "size", F.explode(F.sequence(F.col("__w") - 2, F.col("__w"))).alias("window"), "pos", "x")


def bands(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, low): for each hash function the smallest value over the shingles x of each key."""
    low = sets.groupBy(*keys).agg(*(F.min(F.xxhash64(F.lit(i), "x")).alias(f"b{i}") for i in range(BANDS)))
    return low.select(*keys, F.posexplode(F.array(*(F.col(f"b{i}") for i in range(BANDS)))).alias("band", "low"))


def near_shares(spots: Column, n: Column) -> Column:
    """(pos, near) of ``spots`` (pos, x): how many different x the best run of ``n`` places around each one holds."""
    runs = F.transform(spots, lambda s: F.struct(s["pos"].alias("pos"), F.size(F.array_distinct(F.transform(F.filter(spots, lambda o: o["pos"].between(s["pos"], s["pos"] + n - 1)), lambda o: o["x"]))).alias("near")))
    return let(runs, lambda all_runs: F.transform(all_runs, lambda s: F.struct(s["pos"].alias("pos"), F.array_max(F.transform(F.filter(all_runs, lambda o: s["pos"].between(o["pos"], o["pos"] + n - 1)), lambda o: o["near"])).alias("near"))))


def placed_matches(inside: DataFrame, retrieved: DataFrame, templates: DataFrame, percent: int) -> DataFrame:
    """(key, size, window, t_key, license, n, f, spots): the ``retrieved`` templates of which a window holds ``percent`` of
    the shingles, and where. Both lists are no longer than a window, which grows with the template alone."""
    at = ["key", "size", "window", "t_key"]
    hits = inside.join(templates, ["size", "x"]).join(retrieved, at, "left_semi")
    held = hits.groupBy(*at, "license", "n").agg(F.size(F.collect_set("x")).cast("long").alias("f"), F.collect_list(F.struct("pos", "x")).alias("spots"))
    return held.where(100 * F.col("f") >= percent * F.col("n"))


def winners(matches: DataFrame) -> DataFrame:
    """(key, license, n, f): the ``matches`` that win more than half of their places."""
    of = ["key", "size", "window", "t_key", "license", "n", "f"]
    spots = matches.select(*of, F.inline(near_shares(F.col("spots"), F.col("n")))).withColumn("share", F.col("near") / F.col("n"))
    first = F.max_by("t_key", F.struct("share", "n", -F.col("t_key"))).alias("first")
    won = spots.join(spots.groupBy("key", "pos").agg(first), ["key", "pos"])
    counted = won.groupBy(*of).agg(F.count("*").alias("held"), F.count_if(F.col("first") == F.col("t_key")).alias("own"))
    return counted.where("2 * own > held").select("key", "license", "n", "f")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None, percent: int = 80, words: int = WORDS) -> DataFrame:
    """(``id_col``, license, n_shingles, n_found): the licenses of each document, each with the best of its templates.

    A template matches where ``100 * n_found >= percent * n_shingles``, n_shingles being the number of its distinct
    ``words``-word shingles and n_found those of them that one window of the text holds; each place of the text counts for
    one template only, the smaller number in the list where share and length are equal. A template of fewer words is an
    error. Null, empty and short texts have none, texts of any length are read whole; documents without a license give
    no row, repeated rows of an id are taken together, an empty table gives an empty result, and other columns are not
    looked at. The templates are a parameter of any length; few are broadcast, many joined by a shuffle.
    """
    known = TEMPLATES if known is None else known
    spark = docs.sparkSession
    t = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "key int, license string, text string")
    t_set = shingled(t.where(F.size(_hashes(F.col("text"))) > 0), F.col("key"), F.col("text"), words).select("key", F.array_distinct("s").alias("s"))
    if t.where((F.size(_hashes(F.col("text"))) > 0) & (F.size(_hashes(F.col("text"))) < words)).count():
        raise ValueError(f"a template has fewer than {words} words")
    t_set = t_set.join(t.select("key", "license"), "key").select(F.col("key").alias("t_key"), "license", F.size("s").cast("long").alias("n"), window_size(F.size("s")).alias("size"), "s")
    index = cut(t_set.select("t_key", "license", "n", "size", F.explode("s").alias("x")), "license-shingles")
    sizes = [r[0] for r in index.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return docs.select(id_col).where("false").select(id_col, F.lit("").alias("license"), F.lit(0).cast(LongType()).alias("n_shingles"), F.lit(0).cast(LongType()).alias("n_found"))
    of_list = F.broadcast if index.count() <= BROADCAST_SHINGLES else (lambda df: df)

    texts = shingled(docs, F.col(id_col), F.col(text_col), words)
    placed = texts.select("key", F.posexplode("s").alias("pos", "x"))
    held = cut(placed.join(of_list(index.select("x").distinct()), "x", "left_semi"), "license-places")

    inside = windows(held, sizes)
    of_template = bands(index.select("t_key", "size", "x"), ["t_key", "size"])
    retrieved = bands(inside, ["key", "size", "window"]).join(of_list(of_template), ["size", "band", "low"]).select("key", "size", "window", "t_key").distinct()
    matches = cut(placed_matches(inside, retrieved, of_list(index), percent), "license-matches")
    best = winners(matches).groupBy("key", "license").agg(F.max(F.struct((F.col("f") / F.col("n")).alias("share"), "n", "f")).alias("m"))
    return best.select(F.col("key").alias(id_col), "license", F.col("m.n").alias("n_shingles"), F.col("m.f").alias("n_found"))
