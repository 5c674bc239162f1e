"""Licence notices in texts, in DataFrame functions alone.

A paragraph is a line, and also a run of lines that go on with each other: wrapped notices are
found in the latter.  It is classified by multinomial logistic regression over hashed word uni-
and bigrams, with a class for everything that is no notice.  The model is fitted on notices made
from the templates below and on a bounded sample of other paragraphs; its temperature is
calibrated on held-out ones and on notices that lack words.  A predicted family counts only if
one of its templates agrees.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import table

#: Buckets of word n-grams.
BUCKETS = 1 << 14
#: Paragraphs of no licence that the model learns from, at most.
SAMPLE = 2000
#: A paragraph must be of a family with this probability, and share this part of a template's words.
CERTAIN = 0.7
AGREE = 0.6
#: Weights are stored in hundredths.
SCALE = 100

# Notices of licence families, as their licences word them; fixed values.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "released under the gpl v3",
    ],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license as published by the free software foundation", "released under the lgpl"],
    "agpl": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation", "released under the agpl"],
    "bsd": [
        "released under the bsd license",
        "licensed under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license"],
    "cc_by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "licensed under cc by nc sa 4 0", "licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_nd": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0": ["this work is dedicated to the public domain under cc0 1 0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced without prior written permission", "copyright all rights reserved", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}
FAMILIES = ("none", *TEMPLATES)
_BEFORE = ("", "this file is", "the code is", "note", "copyright 2021 the authors", "all content here is", "this dataset is")
_AFTER = ("", "see the file for details", "for more information", "or later", "by the authors")
#: Sentences that use words of notices but are none.
_OTHER = (
    "he renewed his driving license last week", "the software is free of charge", "the general public was invited", "the apache tribe lived in the south", "a license to drive is required by law",
    "she was granted permission to copy the document", "the foundation published a version of the report", "they work under the terms of the contract", "the mit campus is in cambridge", "use this file to smooth the wood",
    "creative work in the common room", "no rights were reserved", "the public domain of the internet", "gnu herds cross the plain", "the source of the river is subject to drought",
)


#: A line goes on with the one before it if that ends in a letter, digit or sign that ends no sentence; signs of comments do not count.
_GOES_ON = r"""(?<=[A-Za-z0-9,;:)"'])[ \t]*\n[0-9]+\x02[ \t]*(?:(?:#+|//+|\*+|--|;+|>+)[ \t]+)?(?=[A-Za-z0-9("'])"""
#: Texts without any of these words have no wrapped notice.
_HINT = "licen|copyright|permi|redistrib|warrant|reserved|public domain|software"


def _wrapped(text: Column) -> Column:
    """(i, w): the words of each run of lines that go on with each other, with the place of its first line."""
    numbered = F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(i.cast("string"), F.lit("\x02"), x)), "\n")
    runs = F.filter(F.split(F.regexp_replace(numbered, _GOES_ON, "\x01"), "\n"), lambda x: x.contains("\x01"))
    made = F.transform(runs, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("i"), _paragraph_words(F.substring_index(x, "\x02", -1)).alias("w")))
    return F.when(F.lower(text).rlike(_HINT), made).otherwise(F.array().cast("array<struct<i:int,w:array<string>>>"))


def _paragraph_words(line: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), " ")


def _grams(words: Column) -> Column:
    """Buckets of a paragraph's words and of its pairs of words."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    first, second = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    two = F.zip_with(first, second, lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.array_distinct(F.concat(one, two))


def training_notices() -> list[tuple[str, str]]:
    """(text, family) of made notices and of sentences that only resemble them."""
    out = [(" ".join(x for x in (b, t, a) if x), family) for family, texts in TEMPLATES.items() for t in texts for b, a in itertools.product(_BEFORE, _AFTER)]
    return out + [(" ".join(x for x in (b, t) if x), "none") for t in _OTHER for b in _BEFORE]


def held_out_notices() -> list[tuple[str, str]]:
    """(text, family) of notices that lack every fourth word, from the first, second, third or fourth on."""
    lacking = lambda words, k: " ".join(w for i, w in enumerate(words) if i % 4 != k)
    return [(lacking(t.split(), k), family) for family, texts in TEMPLATES.items() for t in texts for k in range(4)] + [(lacking(t.split(), k), "none") for t in _OTHER for k in range(4)]


class Model:
    """Weights of each family by bucket, biases, and a temperature."""

    def __init__(self, grams: list[list[int]], families: list[str], made: int, held: np.ndarray, rounds: int = 250, penalty: float = 2e-4) -> None:
        # Buckets that no notice uses say nothing.
        used = np.array(sorted({b for g in grams[:made] for b in g}))
        x = np.stack([np.isin(used, g) for g in grams]).astype(np.float32)
        y = np.array([FAMILIES.index(f) for f in families])
        counts = np.bincount(y[~held], minlength=len(FAMILIES))
        weight = 1 / np.maximum(1, counts[y[~held]]) / len(FAMILIES)
        w, b = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
        goal = np.eye(len(FAMILIES), dtype=np.float32)[y[~held]]
        train = x[~held]
        for _ in range(rounds):
            z = train @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - goal) * weight[:, None]
            w -= 2.0 * (train.T @ g + penalty * w)
            b -= 2.0 * g.sum(0)
        z = x[held] @ w + b
        loss = lambda t: float((np.log(np.exp(t * (z - z.max(1, keepdims=True))).sum(1)) - t * (z - z.max(1, keepdims=True))[np.arange(len(z)), y[held]]).mean())
        self.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        self.weights = np.zeros((BUCKETS, len(FAMILIES)))
        self.weights[used] = w
        self.bias = b
        #: How much a bucket speaks for any family against none.
        self.cue = np.maximum(0, (self.weights[:, 1:] - self.weights[:, :1]).max(1))
        #: A paragraph whose cues stay below this is surely of no family: even all of it adds up to too little.
        self.least = float(np.log(CERTAIN / (1 - CERTAIN)) / self.temperature + self.bias[0] - self.bias[1:].max())


def fit(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> Model:
    """Fit on made notices and on paragraphs of at most ``sample`` documents that hold no word of theirs.

    The documents with the least hashes of their texts are taken, and of each a line that the
    hash chooses, so the sample does not depend on how the table is partitioned.
    """
    spark = docs.sparkSession
    learnt, lacking = training_notices(), held_out_notices()
    made = learnt + lacking
    known = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "i int, t string").select("i", _grams(_paragraph_words(F.col("t"))).alias("g"))
    grams = [list(r.g) for r in sorted(known.collect(), key=lambda r: r.i)]
    families = [f for _, f in made]
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("hash"), F.split(text_col, "\n").alias("lines"))
    lines = hashed.select("hash", F.get("lines", F.pmod("hash", F.size("lines")).cast("int")).alias("line"))
    plain = lines.where(~F.lower("line").rlike("licen|copyright|permi|redistrib|warrant|rights|public"))
    for r in plain.orderBy("hash", "line").limit(sample).select(_grams(_paragraph_words(F.col("line"))).alias("g")).collect():
        grams.append(list(r.g))
        families.append("none")
    at = np.arange(len(grams))
    return Model(grams, families, len(learnt), np.where(at < len(made), at >= len(learnt), at % 5 == 0))


def _literal(values) -> Column:
    return F.from_json(F.lit(str([int(round(float(v))) for v in values]).replace(" ", "")), "array<int>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, n_paragraphs, notices) of each row of ``docs``; a notice is (paragraph, family, probability, agreement, confirmed).

    Paragraphs are the lines that have a letter or digit (ASCII), counted from 0 over all
    lines.  A notice over several lines that go on with each other is listed by its first line,
    if none of its family is confirmed in a single line.  A null or empty text has none.  Each
    row has its own result, so rows may repeat, share an id or have none.  Of families that are
    equally likely the first in ``FAMILIES`` counts.  Notices that no template confirms are
    listed as such.
    """
    model = model or fit(docs, text_col)
    cue = _literal(np.ceil(SCALE * model.cue))
    tables = [_literal(SCALE * model.weights[:, k]) for k in range(len(FAMILIES))]
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    words = F.transform(lines, _paragraph_words)
    t = docs.select(F.col(id_col).alias("id"), words.alias("words"), _wrapped(F.coalesce(F.col(text_col), F.lit(""))).alias("runs"))
    t = t.select("id", "runs", F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))).alias("words"))
    t = t.select("id", "runs", F.filter("words", lambda p: (F.size(p["w"]) > 0) & (F.get(p["w"], 0) != "")).alias("words"))
    single = F.transform("words", lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"), F.lit(False).alias("run")))
    runs = F.transform("runs", lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"), F.lit(True).alias("run")))
    # The exact bound first: few paragraphs have cues enough to be of any family.
    bound = lambda w: F.aggregate(_grams(w), F.lit(0), lambda s, g: s + F.get(cue, g)) >= int(np.floor(SCALE * model.least))
    t = t.select("id", F.size("words").cast("long").alias("n_paragraphs"), F.filter(F.concat(single, runs), lambda p: bound(p["w"])).alias("likely"))
    # Only rows with such paragraphs go on to all families.
    t = t.withColumn("likely", F.transform("likely", lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"), p["run"].alias("run"), _grams(p["w"]).alias("g"))))

    def total(grams: Column, k: int) -> Column:
        return F.aggregate(grams, F.lit(0), lambda s, g: s + F.get(tables[k], g)) / F.lit(float(SCALE)) + F.lit(float(model.bias[k]))

    z = lambda p: F.array(*(total(p["g"], k) for k in range(len(FAMILIES))))
    t = t.withColumn("scored", F.transform("likely", lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"), p["run"].alias("run"), z(p).alias("z")))).drop("likely")
    best = lambda p: F.array_max(p["z"])
    family = lambda p: F.get(F.array(*map(F.lit, FAMILIES)), (F.array_position(p["z"], best(p)) - 1).cast("int"))
    sure = lambda p: 1 / F.aggregate(p["z"], F.lit(0.0), lambda s, x: s + F.exp((x - best(p)) * model.temperature))
    t = t.withColumn("named", F.transform("scored", lambda p: F.struct(p["i"].alias("i"), p["w"].alias("w"), p["run"].alias("run"), family(p).alias("family"), sure(p).alias("p"))))
    t = t.withColumn("named", F.filter("named", lambda p: (p["family"] != "none") & (p["p"] >= CERTAIN))).drop("scored")
    known = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, dict.fromkeys(text.split()))).alias("w")) for f, texts in TEMPLATES.items() for text in texts))
    share = lambda p: F.aggregate(known, F.lit(0.0), lambda s, x: F.greatest(s, F.when(x["family"] == p["family"], F.size(F.array_intersect(x["w"], p["w"])) / F.size(x["w"])).otherwise(0.0)))
    notice = lambda p: F.struct(p["i"].cast("long").alias("paragraph"), p["family"].alias("family"), F.round(p["p"], 4).alias("probability"), F.round(share(p), 4).alias("agreement"), (share(p) >= AGREE).alias("confirmed"), p["run"].alias("run"))
    t = t.select("id", "n_paragraphs", F.transform("named", notice).alias("found"))
    t = t.withColumn("settled", F.transform(F.filter("found", lambda x: x["confirmed"] & ~x["run"]), lambda x: x["family"]))
    listed = F.filter("found", lambda x: ~x["run"] | (x["confirmed"] & ~F.array_contains("settled", x["family"])))
    notices = F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in ("paragraph", "family", "probability", "agreement", "confirmed"))))
    return t.select(F.col("id").alias(id_col), "n_paragraphs", F.array_sort(notices).alias("notices"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    confirmed = F.filter("notices", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_predicted"),
        F.size(confirmed).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(confirmed, lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
    )
