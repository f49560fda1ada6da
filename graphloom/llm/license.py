"""License scans by diagonal voting.

Texts and templates are cut into words; every k-gram of a text whose hash is one of a template's is a vote for the diagonal (position in the text
- position in the template). Votes are joined in Spark on hash and verified on the k-gram itself, and summed per (text, template, diagonal).
A phrase stands where all k-grams of it vote on one diagonal. For notices, neighbouring diagonals (words put in or left out) are merged, and merged spans are verified: a span is
a chain of votes that go forward both in the text and in the template, each template position once, with at most `shift` words more in the text than in the template between two
of them; its coverage is its share of the template's k-grams.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, ship

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


#: The phrases whose places are counted.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

#: Notices that the licenses themselves tell users to attach, or their opening sentences.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)

#: Up to so many different k-grams of templates, texts are searched for them before their k-grams become rows.
LISTED = 20_000


def words(col: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(col, F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def template_table(spark: SparkSession, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(h, g0 .. g(k-1), template, at, grams, exact): each k-gram position of each template. Templates of fewer than k words are refused."""
    rows = []
    for i, t in enumerate(templates):
        w = t.text.split()
        if len(w) < k:
            raise ValueError(f"a template needs {k} words or more: {t.text}")
        rows += [(*w[j : j + k], i, j, len(w) - k + 1, t.exact) for j in range(len(w) - k + 1)]
    grams = ", ".join(f"g{i} string" for i in range(k))
    df = spark.createDataFrame(rows, f"{grams}, template int, at int, grams int, exact boolean")
    return df.withColumn("h", F.xxhash64(*[f"g{i}" for i in range(k)]))


def chains(votes: list[tuple[int, int]], grams: int, shift: int, least: float, k: int = K) -> list[tuple[float, int, int]]:
    """(coverage, start, end) of the best chains of a template's votes (position in the text, in the template) with at least `least`, best first, none overlapping another in the text.

    A vote follows another if both its positions are greater, and the text goes on by at most `shift` words more than the template does. Of equally long chains the one that
    starts later, so is shorter, counts. A vote looks back at most `grams` + `shift` words, so time grows with the number of votes.
    """
    votes = sorted(votes)
    long: list[tuple[int, int]] = []  # of the best chain that ends at each vote: votes, start
    ends, first = [], 0
    for i, (pos, at) in enumerate(votes):
        while pos - votes[first][0] > grams + shift:
            first += 1
        n, start = 0, -1
        for j in range(first, i):
            p, a = votes[j]
            if a < at and p < pos and pos - p - (at - a) <= shift and long[j] > (n, start):
                n, start = long[j]
        long.append((n + 1, start if n else pos))
        if n + 1 >= least * grams:
            ends.append((n + 1, long[i][1], pos + k))
    out: list[tuple[float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for n, start, end in sorted(ends, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        i = bisect.bisect_left(taken, (end, 0))
        if i == 0 or taken[i - 1][1] <= start:
            taken.insert(i, (start, end))
            out.append((n / grams, start, end))
    return out


SPANS = "array<struct<template:int,start:bigint,end:bigint,coverage:double>>"


def verified(diagonals, sizes: list[int], least: float, shift: int, k: int) -> list[tuple[int, int, int, float]]:
    """Spans (template, start, end, coverage) with at least `least`, in the order of their templates and starts, from a text's (template, diagonal, positions in the template)."""
    by: dict[int, list[tuple[int, list[int]]]] = {}
    for d in diagonals:
        by.setdefault(d["template"], []).append((d["diagonal"], d["ats"]))
    out = []
    for t, ds in sorted(by.items()):
        ds.sort(key=lambda x: x[0])
        groups: list[list] = []
        for d in ds:  # neighbours: a chain never steps further than shift at once, forwards, or than the template is long, backwards
            if groups and d[0] - groups[-1][-1][0] <= max(shift, sizes[t]):
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            if len({a for _, ats in g for a in ats}) >= least * sizes[t]:
                out += [(t, a, b, c) for c, a, b in chains([(d + x, x) for d, ats in g for x in ats], sizes[t], shift, least, k)]
    return sorted(out)


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, k: int = K, least: float = 0.6, shift: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, places (array of (label, start) of exact templates, in order), spans (array of (label, start, end,
    coverage) of the others at `least` coverage), best: the highest coverage of such a template on one diagonal or by a verified span; words are counted from 0.

    Null text: empty. Repeated rows and equal or null ids are documents of their own: votes are grouped by a row number given at the scan, and the text is read once.
    A document's votes, at most one per word and template position, meet in one row. Words repeated over and over can't make up a notice: a template position counts once in a span.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    table = template_table(spark, templates, k)
    known = [r[0] for r in table.select("h").distinct().collect()]  # of the templates, not of the corpus
    w = F.col("w")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    gram = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, *[F.get("w", i + j) for j in range(1, k)]).alias("h"))
    grams = F.slice(F.transform(w, gram), F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
    if len(known) <= LISTED:
        grams = F.filter(grams, lambda g: g["h"].isin(known))
    votes = F.transform(grams, lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), *[F.get("w", g["pos"] + j).alias(f"v{j}") for j in range(k)]))
    hits = base.select("row", "id", F.size(w).cast("bigint").alias("n_words"), votes.alias("votes")).select("row", "id", "n_words", F.explode_outer("votes").alias("g")).select("row", "id", "n_words", "g.*")
    same = F.col("h") == F.col("t_h")
    for j in range(k):
        same = same & (F.col(f"v{j}") == F.col(f"g{j}"))
    table = F.broadcast(table) if len(known) <= LISTED else table
    joined = hits.join(table.withColumnRenamed("h", "t_h"), same, "left").select("row", "id", "n_words", "template", "at", "grams", "exact", (F.col("pos") - F.col("at")).alias("diagonal"))
    # On one diagonal, each template position votes at most once.
    diagonals = joined.groupBy("row", "id", "n_words", "template", "grams", "exact", "diagonal").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    entry = F.struct("template", "diagonal", "ats", "grams", "exact")
    per_doc = diagonals.groupBy("row", "id", "n_words").agg(F.sort_array(F.collect_list(F.when(F.col("template").isNotNull(), entry))).alias("d"))
    labels = F.array(*[F.lit(t.label) for t in templates])
    exact = F.filter("d", lambda d: d["exact"] & (F.size(d["ats"]) == d["grams"]))
    places = F.transform(exact, lambda d: F.struct(F.get(labels, d["template"]).alias("label"), d["diagonal"].cast("bigint").alias("start")))
    loose = F.filter("d", lambda d: ~d["exact"])
    sizes = [len(t.text.split()) - k + 1 for t in templates]

    @F.pandas_udf(SPANS)
    def spans_of(found: pd.Series) -> pd.Series:
        return pd.Series([[] if f is None else [dict(zip(("template", "start", "end", "coverage"), s, strict=True)) for s in verified(f, sizes, least, shift, k)] for f in found], dtype=object)

    # Only where all votes of a text would be enough for the shortest template that has any.
    enough = F.aggregate(loose, F.lit(0), lambda n, d: n + F.size(d["ats"])) >= least * F.array_min(F.transform(loose, lambda d: d["grams"]))
    few = F.transform(loose, lambda d: F.struct(d["template"].alias("template"), d["diagonal"].alias("diagonal"), d["ats"].alias("ats")))
    out = per_doc.withColumn("s", spans_of(F.when(enough, few)))
    on_one = F.coalesce(F.array_max(F.transform(loose, lambda d: F.size(d["ats"]) / d["grams"])), F.lit(0.0))
    best = F.greatest(on_one, F.coalesce(F.array_max(F.transform("s", lambda x: x["coverage"])), F.lit(0.0)))
    spans = F.transform("s", lambda x: F.struct(F.get(labels, x["template"]).alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["coverage"].alias("coverage")))
    return out.select("id", "n_words", places.alias("places"), spans.alias("spans"), best.alias("best"))
