"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of a text, and a run of lines that were wrapped: those that go on over line
ends without a mark that ends a sentence. It is the set of its words and word pairs, hashed to
sparse features;
multinomial logistic regression tells the licence families and the class `unknown` apart. It is
trained on variants of the families' templates and, for `unknown`, on fixed sentences, on near
licences (templates with another version or a restriction) and on a
bounded sample of the corpus's paragraphs that resemble no template. Its probabilities are
calibrated by a temperature chosen on variants and paragraphs that training did not see; a
paragraph whose best family stays under the threshold is unknown. What it identifies is compared
with the family's templates: confirmed is what holds three quarters of the words and word pairs of
one of them, all of those that tell it from its neighbours (other families, other versions), and
no restriction that the template lacks. What is not confirmed is a licence of an unknown family.

Splitting, features, scores and comparison are DataFrame and SQL operations and Spark ML's
transformers (on the JVM); no text leaves the executors.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The families and the wording by which each is known.
TEMPLATES = {
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "bsd-2-clause": [
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc0-1.0": [
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ],
}
#: Grams of a restriction; a paragraph that has one which its template lacks is not confirmed.
RESTRICTIONS = ["noncommercial", "non commercial", "nc", "sharealike", "share alike", "sa", "noderivatives", "no derivatives", "nd", "commons clause", "academic use", "evaluation only"]
#: Sentences that share words with licences and are none.
NOT_LICENSES = [
    "You need a license to drive a car in this country.",
    "Version 3 of the report was released to the public in general terms.",
    "All of the seats in the front rows were reserved for guests.",
    "The general told the public that the work was done.",
    "This work is free and open to any person who asks for it.",
    "The rights of the workers were reserved for a later version.",
    "The permission of the owner is needed to use this road.",
    "The source of the river lies under the hill, and its forms change.",
    "A copy of the file was released under pressure.",
    "The Apache helicopter landed at 2.0 miles from the base.",
    "The foundation published the terms of the award.",
    "He was licensed as a pilot under the old rules.",
]
FAMILIES = [*TEMPLATES, "unknown"]
UNKNOWN = len(TEMPLATES)
BUCKETS = 1 << 13
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(found: Column) -> Column:
    """Words and pairs of neighbours (repeated ones too: features are binary); found must be a plain column."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(found, pairs)


def with_grams(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__words", words(F.col(text))).withColumn("grams", grams(F.col("__words"))).drop("__words")


def only(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds. Unlike a filter this is not pushed below the columns it
    looks at, where they would all be worked out again within the condition."""
    columns = df.columns
    row = F.filter(F.array(F.struct(*columns, condition.alias("__only"))), lambda r: r["__only"])
    return df.select(F.inline(row)).select(*columns)


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    return with_grams(spark.createDataFrame(rows, "family int, template string"), "template")


def _template_literals(spark: SparkSession) -> dict[int, list[list[str]]]:
    out: dict[int, list[list[str]]] = {}
    for r in _template_rows(spark).collect():  # fixed values
        out.setdefault(r.family, []).append(sorted(set(r.grams)))
    return out


def likeness(found: Column, templates: list[list[str]]) -> Column:
    """Largest share of a template's grams that a paragraph holds."""
    shares = [F.size(F.array_intersect(found, F.array(*map(F.lit, t)))) / F.lit(float(len(t))) for t in templates]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def near_licenses() -> list[tuple[str, str]]:
    """(family, sentence) that no template covers: a template with another version or with a restriction."""
    known = {t for texts in TEMPLATES.values() for t in texts}
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            other = re.sub(r"(?<![A-Za-z0-9.])\d+(?:\.\d+)?", lambda m: "1.3" if "." in m[0] else "7", text)
            if other not in known:
                out.append((family, other))
            if family != "all-rights-reserved":
                out += [(family, f"{text} {more}") for more in ("For academic use only.", "With the Commons Clause.")]
                if "-nc-" not in family:
                    out.append((family, f"{text} Non-commercial use only."))
    return out


def marks(templates: dict[int, list[list[str]]], near: list[list[str]], least: float) -> dict[int, list[tuple[list[str], list[str]]]]:
    """For each template the grams that each neighbour lacks (one of another family, or a near
    licence, that holds `least` of the template), and the restrictions that it does not name."""
    out: dict[int, list[tuple[list[str], list[str]]]] = {}
    for family, texts in templates.items():
        others = [set(t) for f, ts in templates.items() if f != family for t in ts] + [set(t) for t in near]
        for t in map(set, texts):
            held = set().union(*(t - u for u in others if len(t & u) >= least * len(t)))
            out.setdefault(family, []).append((sorted(held), [r for r in RESTRICTIONS if r not in t]))
    return out


def variants(seed: int, n: int) -> list[tuple[str, int]]:
    """Templates and copies of them with words lost, and with strange words before or after."""
    rng = random.Random(seed)
    strange = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    out = []
    for label, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            out.append((text, label))
            for _ in range(n):
                found = text.split()
                if len(found) > 6:
                    for _ in range(rng.randint(0, len(found) // 8)):
                        found.pop(rng.randrange(len(found)))
                before, after = ([strange() for _ in range(rng.choice([0, 0, 1, 3, 8]))] for _ in range(2))
                out.append((" ".join(before + found + after), label))
    for text in NOT_LICENSES:
        for _ in range(max(1, n // 4)):
            found = text.split()
            out.append((" ".join([*found, *(strange() for _ in range(rng.randint(0, 4)))]), UNKNOWN))
    for _, text in near_licenses():
        out.append((text, UNKNOWN))
        for _ in range(max(1, n // 4)):
            before, after = ([strange() for _ in range(rng.choice([0, 0, 1, 3, 8]))] for _ in range(2))
            out.append((" ".join([*before, text, *after]), UNKNOWN))
    return out


#: A line's end after which a wrapped paragraph goes on: no mark that ends a sentence before it, no blank line after.
_WRAPPED = r"(?<![.!?:;)\]\"'\s*#$%&])[ \t]*\n(?=[ \t]*\S)"


def paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, wrapped, text: the lines of a text that are not blank (paragraph: the line's
    number from 0), and wrapped runs of several lines (the number of the run among all runs)."""
    text = F.col(text_col).cast("string")
    line = F.transform(F.split(text, "\n"), lambda t, i: F.struct(i.alias("paragraph"), F.lit(False).alias("wrapped"), t.alias("text")))
    runs = F.filter(F.transform(F.split(F.regexp_replace(text, _WRAPPED, "\u0001"), "\n"), lambda t, i: F.struct(i.alias("paragraph"), F.lit(True).alias("wrapped"), t.alias("text"))), lambda r: F.contains(r["text"], F.lit("\u0001")))
    # Lists of one row are laid out one after the other: what a text holds is never grouped.
    out = df.select(F.col(id_col).alias("doc_id"), line.alias("__l"), runs.alias("__r")).select("doc_id", F.inline(F.concat("__l", "__r")))
    return out.withColumn("text", F.translate("text", "\u0001", " ")).where(F.trim("text") != "")


@dataclass
class Scanner:
    model: LogisticRegressionModel
    temperature: float
    templates: dict[int, list[list[str]]]
    near: list[list[str]]


def features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(df)


def train(docs: DataFrame, max_paragraphs: int = 2000, max_docs: int = 300, seed: int = 11) -> Scanner:
    """Fit on variants of the templates and at most max_paragraphs paragraphs of at most max_docs
    documents (in order of a hash of the id) of which no template is half contained. Rows with a
    null id are not sampled, those of one id are sampled together; of an empty table only the
    templates and the fixed sentences are learned."""
    spark = docs.sparkSession
    templates = _template_literals(spark)
    some = docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sampled = paragraphs(docs.join(F.broadcast(some.distinct()), "doc_id", "left_semi"))
    sampled = with_grams(sampled, "text")
    plain = only(sampled, likeness(F.col("grams"), [t for ts in templates.values() for t in ts]) < 0.5)
    plain = plain.orderBy(F.xxhash64("doc_id", "paragraph"), "doc_id", "paragraph").limit(max_paragraphs).select("grams", F.lit(float(UNKNOWN)).alias("label"), (F.pmod(F.xxhash64("doc_id", "paragraph", F.lit(1)), F.lit(4)) == 0).alias("calibrate"))

    def made(seed_: int, calibrate: bool) -> DataFrame:
        given = spark.createDataFrame([(t, float(y)) for t, y in variants(seed_, 24 if not calibrate else 8)], "text string, label double")
        return with_grams(given, "text").select("grams", "label", F.lit(calibrate).alias("calibrate"))

    rows = features(made(seed, False).unionByName(made(seed + 1, True)).unionByName(plain)).coalesce(4).persist()
    model = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial").fit(rows.where("NOT calibrate"))
    scored = model.transform(rows.where("calibrate")).select(vector_to_array("rawPrediction").alias("raw"), F.col("label").cast("int").alias("y"))
    loss = [F.avg(-F.log(F.greatest(_softmax(F.col("raw"), t)[F.col("y")], F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    losses = scored.agg(*loss).first()
    rows.unpersist()
    best = min(range(len(TEMPERATURES)), key=lambda k: (losses[k], k))
    near = with_grams(spark.createDataFrame([(t,) for _, t in near_licenses()], "text string"), "text")
    return Scanner(model, TEMPERATURES[best], templates, [sorted(set(r.grams)) for r in near.collect()])  # fixed values


def _softmax(raw: Column, temperature: float) -> Column:
    """raw must be a plain column."""
    powers = F.transform(raw, lambda v: F.exp((v - F.array_max(raw)) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, confirm: float = 0.75) -> DataFrame:
    """The paragraphs of docs (doc_id, text) in which a licence family is identified.

    Returns doc_id, paragraph, wrapped, family (unknown unless confirmed), predicted, probability
    (calibrated), likeness (to the nearest template of the predicted family), confirmed. A wrapped
    run comes out only if it is confirmed: a line of it may be identified by itself too. Null, empty
    and blank texts have no paragraphs; repeated rows and null ids give rows like others; nothing
    comes from an empty table. Paragraphs are scored one by one where they are read: no shuffle,
    however rows or sources are spread.
    """
    scored = scanner.model.transform(features(with_grams(paragraphs(docs), "text")))
    scored = only(scored.select("doc_id", "paragraph", "wrapped", "grams", "prediction", vector_to_array("rawPrediction").alias("raw")), F.col("prediction") != UNKNOWN)
    k = F.col("prediction").cast("int")
    scored = only(scored.withColumn("probability", _softmax(F.col("raw"), scanner.temperature)[k]), F.col("probability") >= threshold)
    near, sure = F.lit(0.0), F.lit(False)
    found = F.col("grams")
    told = marks(scanner.templates, scanner.near, confirm)
    for family, templates in scanner.templates.items():
        near = F.when(k == family, likeness(found, templates)).otherwise(near)
        any_of = F.lit(False)
        for template, (held, barred) in zip(templates, told[family]):
            whole = F.size(F.array_intersect(F.array(*map(F.lit, held)), found)) == len(held) if held else F.lit(True)
            any_of = any_of | ((likeness(found, [template]) >= confirm) & whole & ~F.arrays_overlap(found, F.array(*map(F.lit, barred))))
        sure = F.when(k == family, any_of).otherwise(sure)
    names = F.array(*map(F.lit, FAMILIES))
    scored = scored.select("doc_id", "paragraph", "wrapped", names[k].alias("predicted"), "probability", near.alias("likeness"), sure.alias("confirmed"))
    scored = only(scored, F.col("confirmed") | ~F.col("wrapped"))
    return scored.select("doc_id", "paragraph", "wrapped", F.when(F.col("confirmed"), F.col("predicted")).otherwise(F.lit("unknown")).alias("family"), "predicted", "probability", "likeness", "confirmed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences found in all documents; nulls and repeated rows as in scan."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
