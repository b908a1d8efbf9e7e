"""Licence scans: units of a text compared to licence templates by Dice coefficient over word bigrams.

Native DataFrame expressions only. The units of a text are its lines, the text as a whole, and
runs of words anywhere in it, across lines too (see ``_runs``), for notices inside a longer
line or wrapped over several. A run is reported with the line it begins in, and only where the
line or the whole text that holds it does not report the same licence already.
A unit is normalised (lower case; runs of anything but letters and digits become one space),
and its bigrams are counted with repetition, so their number is the number of words less one
and bounds the coefficient: Dice >= t needs a size within [t / (2 - t), (2 - t) / t] of the
template's. Units outside every template's bounds are dropped before a bigram is built, and
units without any template bigram before any coefficient is. Before all that, texts are left
out that have none of the words of which every match needs one (see ``cover``).

Defined cases: null and empty texts, and units of fewer than two words, match nothing. Lines
count from 0; the whole text is line -1. Of equal coefficients the template first by name is
reported. Null ids, repeated rows and extra columns pass; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waneline.llm import text as T

#: Fixed texts: short notices by which licences are usually declared.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
THRESHOLD = 0.8
#: Screening words are as long as a template allows, by these steps: short ones are in most texts.
_LENGTHS = (7, 5, 1)
_COMMON = {"a", "an", "and", "any", "be", "by", "can", "for", "from", "in", "is", "it", "may", "of", "on", "or", "that", "the", "this", "to", "with", "you"}


def normalised(text: str) -> list[str]:
    """The words of a template."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold against a template of n."""
    lo = next(k for k in range(n + 1) if 2 * k >= threshold * (k + n))
    hi = max(k for k in range(n, int(n * (2 - threshold) / threshold) + 2) if 2 * n >= threshold * (k + n))
    return lo, hi


def cover(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which any unit that matches a template has one.

    A match shares threshold / (2 - threshold) of the template's bigrams at least, so words
    that touch all but fewer of them cannot all be absent. Chosen greedily, long words first.
    """
    chosen: set[str] = set()
    for name in sorted(templates):
        grams = [tuple(g.split(" ")) for g in bigrams(normalised(templates[name]))]
        least = threshold * len(grams) / (2 - threshold)
        while sum(not chosen & {*g} for g in grams) >= least - 1e-9:
            left = [g for g in grams if not chosen & {*g}]
            words = sorted({w for g in left for w in g})
            long = next(x for x in (*([w for w in words if len(w) >= k and w not in _COMMON] for k in _LENGTHS), words) if x)
            chosen.add(max(long, key=lambda w: sum(w in g for g in left) * len(w)))
    return sorted(chosen)


def _templates(templates: dict[str, str], threshold: float) -> Column:
    """The templates as one array literal, by name, each with its bounds and bigram counts."""
    out = []
    for name in sorted(templates):
        grams = bigrams(normalised(templates[name]))
        lo, hi = bounds(len(grams), threshold)
        counts = F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(grams.count(g)).alias("n")) for g in dict.fromkeys(grams)])
        out.append(F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("size"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), counts.alias("grams")))
    return F.array(*out)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(hits: Column, order: int, name: str, grams: list[str], threshold: float) -> Column:
    """Runs that reach the threshold for one template; of runs that overlap the better, from left to right.

    A best run begins and ends with a bigram of the template, since cutting another off its end
    raises the coefficient. So from each such bigram on, the runs that end at a later one are
    tried, up to the upper bound. A bigram counts while no more of its like lie in the run than
    the template has: while the one so many before (``prev``) lies ahead of the run.
    """
    lo, hi = bounds(len(grams), threshold)
    many = {g: grams.count(g) for g in sorted(set(grams)) if grams.count(g) > 1}

    def needed(g: Column) -> Column:
        out = F.lit(1)
        for gram, n in many.items():
            out = F.when(g == gram, n).otherwise(out)
        return out

    def ranked(own: Column) -> Column:
        def rank(h: Column, j: Column) -> Column:
            like = F.filter(F.slice(own, F.greatest(F.lit(1), j + 1 - hi), F.least(j, F.lit(hi))), lambda x: x["g"] == h["g"])
            prev = _let(F.struct(like.alias("like"), needed(h["g"]).alias("need")), lambda v: F.when(F.size(v["like"]) >= v["need"], F.get(v["like"], F.size(v["like"]) - v["need"])["pos"]).otherwise(-1))
            return F.struct(h["pos"].alias("pos"), h["line"].alias("line"), h["last"].alias("last"), prev.alias("prev"))

        return F.transform(own, rank)

    def best(own: Column, h: Column, j: Column) -> Column:
        zero = F.struct(F.lit(0).alias("shared"), F.lit(-1.0).alias("dice"), F.lit(-1).alias("end"), F.lit(-1).alias("last"))

        def step(acc: Column, x: Column) -> Column:
            shared = acc["shared"] + (x["prev"] < h["pos"]).cast("int")
            dice = F.lit(2.0) * shared / (x["pos"] - h["pos"] + 1 + len(grams))
            better = dice > acc["dice"]
            return F.struct(shared.alias("shared"), F.greatest(dice, acc["dice"]).alias("dice"), F.when(better, x["pos"]).otherwise(acc["end"]).alias("end"), F.when(better, x["last"]).otherwise(acc["last"]).alias("last"))

        found = F.aggregate(F.filter(F.slice(own, j + 1, F.lit(hi)), lambda x: x["pos"] < h["pos"] + hi), zero, step)
        run = _let(found, lambda f: F.struct(h["pos"].alias("start"), f["end"].alias("end"), f["dice"].alias("dice"), F.lit(-order).alias("order"), h["line"].alias("line"), f["last"].alias("last"), F.lit(name).alias("name")))
        return F.when(F.coalesce(F.get(own, j + lo - 1)["pos"] < h["pos"] + hi, F.lit(False)), run)

    def apart(acc: Column, w: Column) -> Column:
        def place(last: Column) -> Column:
            swapped = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(w))
            return F.when(last.isNull() | (w["start"] > last["end"] + 1), F.concat(acc, F.array(w))).when(w["dice"] > last["dice"], swapped).otherwise(acc)

        return _let(F.get(acc, F.size(acc) - 1), place)

    def of(own: Column) -> Column:
        found = F.filter(F.transform(own, lambda h, j: best(own, h, j)), lambda w: F.coalesce(w["dice"] >= threshold, F.lit(False)))
        return F.aggregate(found, F.array().cast(_RUN), apart)

    own = F.filter(hits, lambda h: h["g"].isin(sorted(set(grams))))
    return _let(own, lambda own: F.when(F.size(own) >= lo, _let(ranked(own), of)).otherwise(F.array().cast(_RUN)))


_RUN = "array<struct<start:int,end:int,dice:double,order:int,line:int,last:int,name:string>>"


def _runs(lines: DataFrame, templates: dict[str, str], threshold: float, best: Callable[[Column], Column], whole: Column) -> DataFrame:
    """Runs of words that reach the threshold: doc_id, line (where it begins), license, dice, n_bigrams.

    Runs are taken for each template (see ``_windows``). One of which more than half lies in a
    better one of another template goes (of equal ones the longer is better, then the first by
    name), then one whose licence a line or whole text reports that holds most of it.
    ``lines`` has doc_id and the lines of a text, ``best`` gives the report of a unit's words.
    """
    grams = {name: bigrams(normalised(templates[name])) for name in sorted(templates)}
    limits = [bounds(len(g), threshold) for g in grams.values()]
    reach = sum(2 * max(hi for _, hi in limits) // lo + 2 for lo, _ in limits)  # no more runs than that begin where they could meet one
    known = sorted({g for x in grams.values() for g in x})

    words = F.flatten(F.transform("_lines", lambda u: F.transform(F.filter(F.split(u["unit"], " "), lambda w: w != ""), lambda w: F.struct(u["line"].alias("line"), w.alias("w")))))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.struct(F.concat(a["w"], F.lit(" "), b["w"]).alias("g"), a["line"].alias("line"), b["line"].alias("last")))
    placed = lambda w: F.transform(pairs(w), lambda x, i: F.struct(x["g"].alias("g"), i.alias("pos"), x["line"].alias("line"), x["last"].alias("last")))
    hits = F.filter(_let(words, lambda w: F.when(F.size(w) > 1, placed(w))), lambda h: h["g"].isin(known))
    found = lines.select("doc_id", "_lines", F.explode(F.array(hits)).alias("_hits")).filter(F.size("_hits") >= min(lo for lo, _ in limits))
    every = F.array_sort(F.flatten(F.array(*[_windows(F.col("_hits"), i, name, g, threshold) for i, (name, g) in enumerate(grams.items())])))
    found = found.select("doc_id", "_lines", F.explode(F.array(every)).alias("_runs")).filter(F.size("_runs") > 0)

    n = lambda x: x["end"] - x["start"] + 1
    rank = lambda x: F.struct(x["dice"], n(x), x["order"])
    inside = lambda x, y: F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1
    near = lambda i: F.slice("_runs", F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1))
    kept = F.filter("_runs", lambda x, i: ~F.exists(near(i), lambda y: (rank(y) > rank(x)) & (2 * inside(x, y) > n(x))))
    held = lambda x: F.concat(F.slice("_lines", x["line"] + 1, x["last"] - x["line"] + 1), whole)
    said = lambda x: F.exists(held(x), lambda u: _let(F.split(u["unit"], " "), lambda w: F.coalesce((best(w)["name"] == x["name"]) & (2 * (F.size(w) - 1) > n(x)), F.lit(False))))
    found = found.select("doc_id", "_lines", F.explode(kept).alias("x"))
    found = found.filter(~said(F.col("x")))
    return found.select("doc_id", F.col("x.line").alias("line"), F.col("x.name").alias("license"), F.round("x.dice", 6).alias("dice"), n(F.col("x")).alias("n_bigrams"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per line, whole text or run of words that reaches the threshold: doc_id, line, license, dice (six places), n_bigrams.

    ``templates`` is a driver-side dictionary, written into the plan as a literal.
    """
    templates = TEMPLATES if templates is None else templates
    sizes = {name: len(bigrams(normalised(t))) for name, t in templates.items()}
    lo = min(bounds(n, threshold)[0] for n in sizes.values())
    hi = max(bounds(n, threshold)[1] for n in sizes.values())
    known = F.array(*[F.lit(g) for g in sorted({g for t in templates.values() for g in bigrams(normalised(t))})])
    n_words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1
    fits = lambda s: (F.length(s) > 2) & n_words(s).between(lo + 1, hi + 1)

    words_of_all = F.lower("text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(cover(templates, threshold)) + r")(?![\p{L}\p{N}])")
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split("_plain", "\n"), lambda s, i: F.struct(i.alias("line"), F.trim(s).alias("unit")))
    total = F.aggregate("_lines", F.lit(0), lambda acc, u: acc + F.when(u["unit"] == "", 0).otherwise(n_words(u["unit"])))
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.when(total <= hi + 1, F.array_join(F.transform(F.filter("_lines", lambda u: u["unit"] != ""), lambda u: u["unit"]), " ")).otherwise("").alias("unit")))
    split = docs.filter(words_of_all).select("doc_id", plain.alias("_plain")).select("doc_id", lines.alias("_lines"))
    units = split.select("doc_id", F.explode(F.filter(F.concat(whole, "_lines"), lambda u: fits(u["unit"]))).alias("u"))

    words = F.split("unit", " ")
    n = F.size("words")
    grams = F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    units = units.select("doc_id", "u.line", F.col("u.unit").alias("unit")).select("doc_id", "line", words.alias("words")).select("doc_id", "line", grams.alias("grams"))
    units = units.filter(F.arrays_overlap("grams", known)).withColumn("n_bigrams", F.size("grams"))

    def scores(grams: Column, size: Column) -> Column:
        def dice(t: Column) -> Column:
            shared = F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.least(g["n"], F.size(F.filter(grams, lambda x: x == g["gram"]))))
            return F.lit(2.0) * shared / (size + t["size"])

        near = F.filter(_templates(templates, threshold), lambda t: size.between(t["lo"], t["hi"]))
        return F.array_max(F.transform(near, lambda t, i: F.struct(dice(t).alias("dice"), (-i).alias("order"), t["name"].alias("name"))))

    def reported(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        best = _let(pairs, lambda grams: scores(grams, F.size(grams)))
        return F.when(F.size(w).between(lo + 1, hi + 1), _let(best, lambda b: F.when(b["dice"] >= threshold, b)))

    best = units.withColumn("best", scores(F.col("grams"), F.col("n_bigrams"))).filter(F.col("best.dice") >= threshold)
    best = best.select("doc_id", "line", F.col("best.name").alias("license"), F.round("best.dice", 6).alias("dice"), "n_bigrams")
    return best.unionByName(_runs(split, templates, threshold, reported, whole))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of ``documents``."""
    return scan(T.table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ",\n    ".join("('" + name + "', '" + " ".join(normalised(t)) + "')" for name, t in sorted(TEMPLATES.items()))
    return f"""
WITH t AS (
  SELECT name, string_split(words, ' ') AS w FROM (VALUES
    {values}) AS v(name, words)
), tg AS (
  SELECT name, len(w) - 1 AS size, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM t
), tc AS (
  SELECT name, size, gram, count(*) AS n FROM tg GROUP BY ALL
), p AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS plain FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, r, -1 AS line, trim(regexp_replace(plain, '[ \\n]+', ' ', 'g')) AS unit FROM p
  UNION ALL
  SELECT doc_id, r, unnest(range(len(s))) AS line, trim(unnest(s)) AS unit FROM (SELECT doc_id, r, string_split(plain, chr(10)) AS s FROM p)
), u AS (
  SELECT doc_id, r, line, string_split(unit, ' ') AS w FROM l WHERE contains(unit, ' ') AND len(unit) - len(replace(unit, ' ', '')) <= 400
), ug AS (
  SELECT doc_id, r, line, len(w) - 1 AS n_bigrams, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM u
), uc AS (
  SELECT doc_id, r, line, n_bigrams, gram, count(*) AS n FROM ug GROUP BY ALL
), d AS (
  SELECT doc_id, r, line, n_bigrams, name, 2.0e0 * sum(least(uc.n, tc.n)) / (n_bigrams + size) AS dice
  FROM uc JOIN tc USING (gram) GROUP BY doc_id, r, line, n_bigrams, name, size
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY dice DESC, name) AS k FROM d WHERE dice >= {THRESHOLD}
)
SELECT doc_id, CAST(line AS INTEGER) AS line, name AS license, round(dice, 6) AS dice, CAST(n_bigrams AS INTEGER) AS n_bigrams FROM best WHERE k = 1
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _sql()}
