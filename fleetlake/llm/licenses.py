"""License scans by DataFrame functions alone: TF-IDF cosine to templates, then inheritance along directories.

A file's text is cut into sentences and lines; these and runs of them are its ``units``, so that wrapped wordings are seen as one; a
file named like a licence file is also one unit, held against whole licence texts, which then go first. A unit's cosine to a template is taken over sparse TF-IDF vectors; idf comes from
the document frequency of every term in the whole input. Before vectors are made, a unit must hold one of the terms that a cosine of
``least`` needs: a template's lighter terms alone cannot reach it (their norm is below ``least`` times the template's), and it must reach
``least`` if all terms that no template has weighed 1, the least weight there is: nothing is lost. Weights of other terms
are looked up for what remains. The best template of the best unit is the file's own licence. Ties go to the smallest template name.

All terms cross the network once, counted per task first, and their counts are checkpointed; texts do not.

A file named like a licence file, or one that is nearly all licence text, gives its licence to its directory. A file without an own licence takes
that of its nearest ancestor directory: the path is joined once per level with the directories that have a licence.

Null texts and paths: a null text has no units; a null path has no directory, gives and inherits nothing. Two licence files of a directory:
the best cosine wins, then the smallest name. Empty inputs give empty results. Repeated rows give repeated results. Only named
columns are returned.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import checkpointed, documents

# The wording of licence notices, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
UNIT_ENDS = r"\n+|(?<=[.!?])\s+"
TERM_ENDS = r"[\x00-/:-@\[-`{-~]+"  # ASCII but letters and digits; a bit table decides, other letters belong to words
LEAST = 0.7
MOSTLY = 0.9
BROADCAST_BYTES = 4 << 20  # of text and 32 bytes a row


def terms(text: Column) -> Column:
    """Lower-case words and numbers, in order, with repeats."""
    return F.array_remove(F.split(F.lower(text), TERM_ENDS), "")


def template_terms(templates: dict[str, list[str]]) -> tuple[list[tuple[str, dict[str, int]]], list[str]]:
    """Term counts of each wording, and all terms (some hundreds or few thousands; they are part of the query)."""
    counted = []
    for name in sorted(templates):
        for text in templates[name]:
            words = [w for w in re.split(TERM_ENDS, text.lower()) if w]
            counted.append((name, {w: words.count(w) for w in sorted(set(words))}))
    return counted, sorted({w for _, c in counted for w in c})


def frequencies(files: DataFrame, text: str) -> DataFrame:
    """(term, count): how many files hold each term."""
    return checkpointed(files.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").count())


def weight(total: int, count: Column) -> Column:
    """Inverse document frequency, at least 1."""
    return F.log((1 + F.lit(total)) / (1 + count)) + 1


def own_licenses(
    files: DataFrame, key: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST, path: str | None = None
) -> DataFrame:
    """(key, license, cosine, share): the best template of each file that has one, and the share of its text in licence units.

    With a ``path`` column, files named like licence files are held against whole licence texts too.
    """
    counted, vocabulary = template_terms(templates or TEMPLATES)
    held, total = frequencies(files, text), files.count()
    idf = idf_of(held, total, vocabulary)
    rows = files.select(F.col(key).alias("k"), F.col(text).alias("text"), (F.col(path) if path else F.lit(None).cast("string")).alias("p"))
    wanted = F.array(*map(F.lit, needed(counted, idf, least)))
    near = rows.where(F.arrays_overlap(terms(F.col("text")), wanted)).select("k", "text").withColumn("row", F.monotonically_increasing_id())
    found = scored(windows(near, wanted, max(sum(c.values()) for _, c in counted)), counted, idf, held, total, least)
    # Windows whose first and last unit both add to the cosine; others hold text beside the notice.
    shorter = [F.lag(F.struct("best.minus", "width")).over(Window.partitionBy("row", side).orderBy("width")) for side in ("at", "end")]
    found = found.withColumn("end", F.col("at") + F.col("width")).withColumns({"a": shorter[0], "b": shorter[1]})
    found = found.where(" and ".join(f"({s} is null or {s}.width < width - 1 or best.minus < {s}.minus)" for s in "ab"))
    units = found.select("k", "whole", "best", "at", F.posexplode("sizes").alias("i", "size")).groupBy("k", (F.col("at") + F.col("i")).alias("place"))
    best = units.agg(F.min("best").alias("best"), F.max("size").alias("size"), F.max("whole").alias("whole")).groupBy("k").agg(
        F.min(F.struct(F.lit(1).alias("rank"), "best")).alias("best"), (F.sum("size") / F.max("whole")).alias("share"))
    if path and templates is None:
        counted, vocabulary = template_terms(whole_templates())
        texts = rows.where(named_license(F.col("p"))).select(F.monotonically_increasing_id().alias("row"), "k", terms(F.col("text")).alias("terms"))
        words = texts.select("row", "k", F.explode("terms").alias("t")).groupBy("row", "k", "t").agg(F.count("*").cast("int").alias("n"))
        full = scored(words.groupBy("row", "k").agg(F.collect_list(F.struct("t", "n")).alias("bag")), counted, idf_of(held, total, vocabulary), held, total, least)
        full = full.groupBy("k").agg(F.min(F.struct(F.lit(0).alias("rank"), "best")).alias("best"))
        # A whole licence says more than the wordings in it.
        best = best.unionByName(full.withColumn("share", F.lit(1.0))).groupBy("k").agg(F.min("best").alias("best"), F.max("share").alias("share"))
    return best.select(F.col("k").alias(key), F.col("best.best.license").alias("license"), (-F.col("best.best.minus")).alias("cosine"), "share")


def windows(rows: DataFrame, wanted: Column, longest: int) -> DataFrame:
    """Every unit and every run of consecutive units with at most ``longest`` terms between its first and its last, if it holds a wanted term.

    A wording's inner lines lie between those two, so that it is seen as one however it is wrapped. Comment marks are no terms.
    """
    parts = F.transform(F.split("text", UNIT_ENDS), lambda u: F.struct(F.length(u).alias("size"), terms(u).alias("terms")))
    rows = rows.select("row", "k", F.length("text").alias("whole"), F.filter(parts, lambda p: F.size(p["terms"]) > 0).alias("parts"))
    rows = rows.where(F.size("parts") > 0).withColumn("hit", F.transform("parts", lambda p: F.arrays_overlap(p["terms"], wanted)))
    reach = longest + 2

    def inner(i: Column) -> Column:
        """How many units after the next one the window from i on may go."""
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        return F.aggregate(
            F.slice("parts", i + 2, reach), start,
            lambda a, p: F.struct((a["sum"] + F.size(p["terms"])).alias("sum"), (a["n"] + F.when(a["sum"] + F.size(p["terms"]) <= longest, 1).otherwise(0)).alias("n")), lambda a: a["n"])

    starts = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.exists(F.slice("hit", i + 1, reach), lambda h: h))
    spots = rows.select("row", "k", "whole", F.inline(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("parts", i + 1, inner(i) + 2).alias("near")))))
    runs = F.transform(F.sequence(F.lit(1), F.size("near")), lambda w: F.struct(
        w.alias("width"), F.transform(F.slice("near", 1, w), lambda p: p["size"]).alias("sizes"), F.flatten(F.transform(F.slice("near", 1, w), lambda p: p["terms"])).alias("terms")))
    return spots.select("row", "k", "whole", "at", F.inline(runs)).where(F.arrays_overlap("terms", wanted))


def whole_templates() -> dict[str, list[str]]:
    """Whole licence texts by SPDX name, from the files beside this module.

    The AGPL's is the GPL's text with its own name, which is what sets their terms apart.
    """
    texts = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = re.sub(r"GNU\s+GENERAL\s+PUBLIC", "GNU Affero General Public", texts["GPL-3.0"], flags=re.IGNORECASE)
    return {name: [text] for name, text in texts.items()}


def named_license(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE)


def idf_of(held: DataFrame, total: int, vocabulary: list[str]) -> dict[str, float]:
    """Weights of the templates' terms."""
    import math

    counts = {r["term"]: r["count"] for r in held.where(F.col("term").isin(vocabulary)).collect()}  # a row for each template term at most
    return {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def needed(counted: list[tuple[str, dict[str, int]]], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a unit must hold one."""
    out = set()
    for _, c in counted:
        w = {t: n * idf[t] for t, n in c.items()}
        norm, light = sum(x * x for x in w.values()) ** 0.5, 0.0
        for t in sorted(w, key=lambda t: (w[t], t)):
            light += w[t] ** 2
            if light**0.5 >= least * norm - 1e-9:
                out.add(t)
    return sorted(out)


def scored(units: DataFrame, counted: list[tuple[str, dict[str, int]]], idf: dict[str, float], held: DataFrame, total: int, least: float) -> DataFrame:
    """The units whose cosine to a template is ``least`` or more: their other columns and ``best`` (minus the cosine, license).

    Units have their ``terms`` or, long ones, their ``bag`` of (t, n), as counting within an array takes its length times its different terms.
    """
    names, table, vocabulary = [c for c in units.columns if c not in ("terms", "bag")], literal(idf, "map<string,double>"), literal(list(idf), "array<string>")

    def times(t: Column) -> Column:
        return F.size(F.filter("terms", lambda o: o == t))

    # A unit as a sparse vector: its different template terms, each with its count and count * idf.
    if "bag" in units.columns:
        counts, size = F.filter("bag", lambda b: F.array_contains(vocabulary, b["t"])), F.aggregate("bag", F.lit(0), lambda a, b: a + b["n"])
        rare = F.filter("bag", lambda b: ~F.array_contains(vocabulary, b["t"]))
    else:
        counts, size = F.transform(F.array_intersect("terms", vocabulary), lambda t: F.struct(t.alias("t"), times(t).alias("n"))), F.size("terms")
        rare = F.transform(F.array_except("terms", vocabulary), lambda t: F.struct(t.alias("t"), times(t).alias("n")))
    vectors = units.withColumn("v", F.transform(counts, lambda c: F.struct(c["t"].alias("t"), c["n"].alias("n"), (c["n"] * F.element_at(table, c["t"])).alias("w"))))
    dots = []
    for name, c in counted:
        length = sum((n * idf[t]) ** 2 for t, n in c.items()) ** 0.5
        own = literal({t: n * idf[t] / length for t, n in c.items()}, "map<string,double>")
        dots.append(F.struct((-_dot(own)).alias("minus"), F.lit(name).alias("license")))
    vectors = vectors.withColumn("best", F.array_min(F.array(*dots)))  # the norm is the same for all templates, so the largest product is the best
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
    others = size - F.aggregate("v", F.lit(0), lambda a, x: a + x["n"])
    near = vectors.withColumn("square", square).where(-F.col("best.minus") >= (least - 1e-6) * F.sqrt(F.col("square") + others))
    near = checkpointed(near.select(F.monotonically_increasing_id().alias("id"), *names, "best", "square", F.transform(rare, lambda r: F.struct(r["t"].alias("term"), r["n"].alias("n"))).alias("other")))
    asked = near.select("id", F.inline("other"))
    few = checkpointed(asked.select("term").distinct())
    weights = checkpointed(held.join(where_small(few, "term"), "term").select("term", weight(total, F.col("count")).alias("idf")))
    weights = where_small(weights, "term")
    rest = asked.join(weights, "term").groupBy("id").agg(F.sum((F.col("n") * F.col("idf")) ** 2).alias("rest"))
    cosine = near.join(rest, "id", "left").withColumn("minus", F.round(F.col("best.minus") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), 9))
    return cosine.where(F.col("minus") <= -least).select(*names, F.struct("minus", F.col("best.license").alias("license")).alias("best"))


def where_small(rows: DataFrame, *texts: str) -> DataFrame:
    """The rows with a broadcast hint, if their texts and their number stay within BROADCAST_BYTES."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(32))
    return F.broadcast(rows) if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else rows


def literal(values: dict | list, kind: str) -> Column:
    """One constant, however many values it holds."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _dot(weights: Column) -> Column:
    return F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at(weights, x["t"]), F.lit(0.0)))


def ancestors(path: Column) -> Column:
    """All directories of a path, the nearest first; the root is the empty text."""
    names = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.array_join(F.slice(names, 1, i), "/")))


def scan(files: DataFrame, key: str = "path", path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(key, license, cosine, origin, directory) of all files: ``own``, ``inherited`` (with the directory it comes from) or null."""
    rows = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("text"))
    own = checkpointed(own_licenses(rows, "k", "text", templates, least, "p"))  # one row per licensed file, used three times
    named = rows.select("k", "p").join(own.withColumnRenamed("k", "own key"), F.col("k") == F.col("own key"), "left").drop("own key")
    parent = F.element_at(ancestors(F.col("p")), 1)
    gives = F.col("license").isNotNull() & F.col("p").isNotNull() & (named_license(F.col("p")) | (F.col("share") >= MOSTLY))
    given = named.where(gives).groupBy(parent.alias("at")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("given"))
    # Directories repeat far less than files: each distinct one looks for its nearest ancestor once.
    folders = named.where("license is null and p is not null").select(parent.alias("folder")).distinct()
    above = folders.select("folder", F.posexplode(ancestors(F.concat(F.col("folder"), F.when(F.col("folder") == "", "").otherwise("/")))).alias("up", "at"))
    nearest = checkpointed(above.join(given, "at").groupBy("folder").agg(F.min(F.struct("up", "at", "given")).alias("found")))
    # One folder may hold a third of all files: few folders go to the files, many meet them in a join that splits large keys.
    nearest = where_small(nearest, "folder", "found.at")
    joined = named.withColumn("folder", F.when(F.col("license").isNull(), parent)).join(nearest, "folder", "left")
    return joined.select(
        F.col("k").alias(key), F.coalesce("license", F.col("found.given.license")).alias("license"),
        F.coalesce("cosine", -F.col("found.given.minus")).alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("found").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("found.at")).alias("directory"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the file source/lang/doc_id.txt."""
    docs = documents(spark, sf_dir)
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan(files, "doc_id")
