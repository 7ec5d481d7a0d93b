"""Licence scans: a sparse logistic regression over the words and word pairs of paragraphs, with templates to confirm.

The model has a class for paragraphs without a licence and one for each family, and a temperature fitted
on variants it hasn't seen. A paragraph that is licence-like but not surely of one family, or not borne
out by one of the family's templates, is ``unknown``. Paragraphs are lines, blocks of lines that no blank one parts, and
the runs of lines in a block that bear out a template, so a wrapped notice is found within any text. Everything happens within the
row: the words of each line are found once, and a block or line is scored only if its words could make it licence-like. That bound
is exact: the weights that speak for a class, of all the model's words in it and of pairs of such words, must outweigh what speaks for none.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Family and notice, as the families' publishers word them. Fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc_by_nc", "Licensed under CC BY-NC 4.0."),
    ("cc_by_nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
#: Paragraphs that hold no family's notice: plain ones, and ones that speak of licences. Fixed values.
OTHER = (
    "The driver showed a license and went on.", "She has permission to leave the house.", "Version 3 of the plan is under review.", "The general public was free to enter.", "A copy of the file was made for the work.",
    "They use this software in the school.", "The following conditions are met by all.", "Under the bridge the water was cold.", "He released the bird and it flew away.", "Creative work needs time and rest.", "An international foundation published the terms.",
)
VAGUE = (
    "All rights reserved.", "This software is proprietary and licensed to one customer.", "See the license file for terms.", "Licensed for private use only.", "Copyright by the authors, license on request.", "Use is subject to a license agreement.",
)
#: Words that say nothing of licences; they fill the training paragraphs. Fixed values.
COMMON = "a all any and are as at by for file from general he in is it of on or other public school see terms that the their these they this to use version was water with work you".split()
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
CLASSES = ("none", "unknown", *FAMILIES)
_TOKEN = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"
SURE, BORNE_OUT = 0.8, 0.6
#: Lines of the longest runs: as many as the longest template has words, so that any wrapping of it fits.
LONGEST = max(len(text.split()) for _, text in TEMPLATES)


def terms(text: str) -> set[str]:
    words = re.findall(_TOKEN, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    vocabulary: list[str]
    weights: object  # terms x classes
    bias: object
    temperature: float


def _variants(seed: int, n: int):
    """Notices with words left out and foreign words around; (text, class)."""
    import random

    r = random.Random(seed)
    foreign = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(r.randint(2, 4)))
    out = []
    for i in range(n):
        label, source = [("none", OTHER), ("none", OTHER), ("none", OTHER), ("unknown", VAGUE), *((f, tuple(t for g, t in TEMPLATES if g == f)) for f in FAMILIES)][i % (len(CLASSES) + 2)]
        words = [w for w in r.choice(source).split() if r.random() > 0.12]
        filler = lambda n: [foreign() if r.random() < 0.4 else r.choice(COMMON) for _ in range(n)]
        around = filler(r.choice((0, 0, 3, 12)))
        if label == "none" and r.random() < 0.8:
            words = r.sample(words, len(words) // 3) if r.random() < 0.3 else []
            around = filler(r.choice((1, 2, 4, 8, 20, 60, 200)))
        out.append((" ".join(around + words), label))
    return out


def train(n: int = 1600, seed: int = 3) -> Model:
    """Multinomial logistic regression by gradient descent on ``n`` variants; half as many others set the temperature."""
    import numpy as np

    rows, fresh = _variants(seed, n), _variants(seed + 1, n // 2)
    vocabulary = sorted({t for _, source in TEMPLATES for t in terms(source)} | {t for s in (*OTHER, *VAGUE, *COMMON) for t in terms(s)})
    place = {t: i for i, t in enumerate(vocabulary)}

    def matrix(texts):
        x = np.zeros((len(texts), len(vocabulary)))
        for i, (text, _) in enumerate(texts):
            x[i, [place[t] for t in terms(text) if t in place]] = 1
        return x, np.eye(len(CLASSES))[[CLASSES.index(c) for _, c in texts]]

    x, y = matrix(rows)
    w, b = np.zeros((len(vocabulary), len(CLASSES))), np.zeros(len(CLASSES))
    b[0] = 2.0  # a paragraph without terms has no licence
    soft = lambda z: (e := np.exp(z - z.max(1, keepdims=True))) / e.sum(1, keepdims=True)
    for _ in range(400):
        d = (soft(x @ w + b) - y) / len(x)
        w -= 2.0 * (x.T @ d + 1e-4 * w)
        b -= 0.2 * d.sum(0)
    x, y = matrix(fresh)
    loss = lambda t: -np.mean(np.log((soft((x @ w + b) / t) * y).sum(1) + 1e-12))
    return Model(vocabulary, w, b, float(min(np.geomspace(0.3, 5, 40), key=loss)))


def _let(column: Column, use) -> Column:
    """``use`` of ``column``, which is worked out once."""
    return F.element_at(F.transform(F.array(column), use), 1)


def _constant(rows: list, kind: str) -> Column:
    """A value of an SQL type, given as JSON: the optimiser makes one literal of it, wherever it stands."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1))


def _grams(words: Column) -> Column:
    """The distinct words and pairs of a sequence of words."""
    less = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, 1, less(w)), F.slice(w, 2, less(w)), lambda a, b: F.concat_ws(" ", a, b))
    return _let(words, lambda w: F.array_distinct(F.concat(w, pairs(w))))


def _whole(x: float, up: bool = False) -> int:
    """Weights and bounds in millionths: sums of whole numbers have no order."""
    return math.ceil(round(x * 1e6, 3)) if up else round(x * 1e6)


def _may_be_licence(model: Model):
    """A test of a sequence of words: False only where no part of it, in any order of its words, is licence-like.

    With z the logits, a paragraph isn't licence-like if exp(z_0) > (1 - SURE) sum exp(z), which holds if z_c - z_0 is below
    ln(SURE / (1 - SURE) / other classes) for every class c but none. Terms of a part are among those of the whole.
    """
    least = math.log(SURE / (1 - SURE) / (len(CLASSES) - 1)) * model.temperature
    gains = [[_whole(max(round(float(w[c]), 6) - round(float(w[0]), 6), 0.0), up=True) for c in range(1, len(CLASSES))] for w in model.weights]
    needs = [_whole(least - float(model.bias[c]) + float(model.bias[0])) - 1 for c in range(1, len(CLASSES))]
    numbers = lambda g: {f"g{c}": x for c, x in enumerate(g)}
    singles = [(t, g) for t, g in zip(model.vocabulary, gains, strict=True) if " " not in t]
    pairs = [(t.split(" "), g) for t, g in zip(model.vocabulary, gains, strict=True) if " " in t and any(g)]
    known = _constant([t for t, _ in singles], "array<string>")
    rows = [{"a": t, "b": t, **numbers(g)} for t, g in singles if any(g)] + [{"a": a, "b": b, **numbers(g)} for (a, b), g in pairs]
    table = _constant(rows, "array<struct<a: string, b: string, " + ", ".join(f"g{c}: bigint" for c in range(len(needs))) + ">>")

    def reaches(held: Column) -> Column:
        here = F.filter(table, lambda v: F.array_contains(held, v["a"]) & F.array_contains(held, v["b"]))
        zero = F.struct(*(F.lit(0).cast("long").alias(f"g{c}") for c in range(len(needs))))
        add = lambda acc, v: F.struct(*((acc[f"g{c}"] + v[f"g{c}"]).alias(f"g{c}") for c in range(len(needs))))
        enough = lambda acc: sum(((acc[f"g{c}"] >= needs[c]).cast("int") for c in range(len(needs))), F.lit(0)) > 0
        return F.aggregate(here, zero, add, enough)

    return lambda words: _let(F.array_intersect(known, words), lambda held: F.when(F.size(held) > 0, reaches(held)).otherwise(F.lit(max(needs) <= 0)))


def _bears_out(grams: Column) -> Column:
    """Whether the terms reach BORNE_OUT of any template; if a text's don't, no part's do."""
    own = _constant([sorted(terms(text)) for _, text in TEMPLATES], "array<array<string>>")
    every = _constant(sorted({t for _, text in TEMPLATES for t in terms(text)}), "array<string>")
    reaches = lambda held: F.exists(own, lambda t: F.size(F.array_intersect(t, held)) >= BORNE_OUT * F.size(t))
    return _let(F.array_intersect(every, grams), lambda held: F.exists(held, lambda t: t.contains(" ")) & reaches(held))


def _units(tokens: Column, first: Column, may: Callable[[Column], Column]) -> Column:
    """Of a block of lines, given as the words of each, the first being number ``first``: a, b (first and last line) and terms of each line that may be a licence, of the block, and of the runs of lines that bear out a template."""
    n, unit = F.size(tokens), lambda a, b, t: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), t.alias("terms"))
    run = lambda i, k: F.flatten(F.slice(tokens, i + 1, k))
    sizes = lambda i: F.sequence(F.lit(2), F.least(F.lit(LONGEST), n - i))
    # The terms of a run are among those of the longest run from its first line, and these among the block's.
    one = lambda i, k, w: F.when(may(w), _let(_grams(w), lambda t: F.when(_bears_out(t), unit(first + i, first + i + k - 1, t))))
    from_line = lambda i: F.filter(F.transform(sizes(i), lambda k: F.when(k < n, _let(run(i, k), lambda w: one(i, k, w)))), lambda u: u.isNotNull())
    starts = F.filter(F.sequence(F.lit(0), n - 2), lambda i: _let(run(i, F.lit(LONGEST)), lambda w: F.when(may(w), _bears_out(_grams(w))).otherwise(F.lit(False))))
    none = F.array().cast("array<struct<a: int, b: int, terms: array<string>>>")
    whole = _let(_grams(F.flatten(tokens)), lambda t: F.concat(F.array(unit(first, first + n - 1, t)), F.when(_bears_out(t), F.flatten(F.transform(starts, from_line))).otherwise(none)))
    lines = F.filter(F.transform(tokens, lambda x, i: F.when(may(x), unit(first + i, first + i, _grams(x)))), lambda u: u.isNotNull())
    return F.concat(lines, F.when(n > 1, whole).otherwise(none))


def _blocks(text: Column) -> Column:
    """first (number of the first line), tokens (words of each line) of each block of consecutive lines with a letter or digit."""
    full = lambda lines: F.transform(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))
    edge = lambda f, step: F.filter(F.transform(f, lambda x, i: F.when(x & ~F.coalesce(F.get(f, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
    block = lambda lines, a, b: F.struct(a.alias("first"), F.transform(F.slice(lines, a + 1, b - a + 1), _words).alias("tokens"))
    return _let(F.split(text, "\n"), lambda lines: _let(full(lines), lambda f: F.zip_with(edge(f, -1), edge(f, 1), lambda a, b: block(lines, a, b))))


def _judged(unit: Column, model: Model) -> Column:
    """rank, more, less (what ``_settled`` orders by), place, last (numbers of lines), family, probability, borne_out of a unit; null if it isn't licence-like."""
    own = [terms(text) for _, text in TEMPLATES]
    z_names, t_names = [f"z{i}" for i in range(len(CLASSES))], [f"t{i}" for i in range(len(own))]
    row = lambda t, w: {"term": t, **{n: _whole(round(float(x), 6)) for n, x in zip(z_names, w, strict=True)}, **{n: int(t in o) for n, o in zip(t_names, own, strict=True)}}
    table = _constant([row(t, w) for t, w in zip(model.vocabulary, model.weights, strict=True)], "array<struct<term: string, " + ", ".join(f"{n}: bigint" for n in (*z_names, *t_names)) + ">>")
    known = _constant(model.vocabulary, "array<string>")
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in (*z_names, *t_names)))
    add = lambda acc, v: F.struct(*((acc[n] + v[n]).alias(n) for n in (*z_names, *t_names)))

    def judge(sums: Column) -> Column:
        z = [(sums[n] / 1e6 + float(model.bias[i])) / model.temperature for i, n in enumerate(z_names)]
        return _let(F.struct(*(x.alias(n) for x, n in zip(z, z_names, strict=True)), *((sums[n] / len(o)).alias(n) for n, o in zip(t_names, own, strict=True))), weigh)

    def weigh(s: Column) -> Column:
        top = F.greatest(*(s[n] for n in z_names))
        return _let(F.struct(*(F.exp(s[n] - top).alias(n) for n in z_names), *(s[n].alias(n) for n in t_names)), name)

    def name(e: Column) -> Column:
        best, every = F.greatest(*(e[n] for n in z_names[2:])), sum((e[n] for n in z_names), F.lit(0.0))
        share = {f: [e[n] for n, (g, _) in zip(t_names, TEMPLATES, strict=True) if g == f] for f in FAMILIES}
        borne = F.coalesce(*(F.when(e[z_names[2 + k]] == best, F.greatest(F.lit(0.0), *share[f])) for k, f in enumerate(FAMILIES)))
        named = F.coalesce(*(F.when(e[z_names[2 + k]] == best, F.lit(f)) for k, f in enumerate(FAMILIES)))
        family = F.when((best / every >= SURE) & (borne >= BORNE_OUT), named).otherwise("unknown")
        order = (F.round(-borne, 6).alias("rank"), (unit["b"] - unit["a"]).alias("more"), F.round(-(best / every), 6).alias("less"))
        return F.when(e["z0"] <= (1 - SURE) * every, F.struct(*order, unit["a"].alias("place"), unit["b"].alias("last"), family.alias("family"), (best / every).alias("probability"), borne.alias("borne_out")))

    return _let(F.array_intersect(known, unit["terms"]), lambda held: F.aggregate(F.filter(table, lambda v: F.array_contains(held, v["term"])), zero, add, judge))


def _settled(units: Column) -> Column:
    """Of the licence-like units of a block, its notices.

    Lines of a family stay. Of runs of lines, the best borne out and then shortest goes first, unless it meets a notice
    of its family; an ``unknown`` line stays unless a run holds it, and a block is ``unknown`` if nothing else is in it.
    """
    meets = lambda u, v: (u["place"] <= v["last"]) & (v["place"] <= u["last"])
    known, single = lambda u: u["family"] != "unknown", lambda u: u["place"] == u["last"]
    lines = F.filter(units, lambda u: known(u) & single(u))
    runs = F.array_sort(F.filter(units, lambda u: known(u) & ~single(u)))
    taken = lambda kept: F.aggregate(runs, kept, lambda acc, u: F.when(F.exists(acc, lambda v: (u["family"] == v["family"]) & meets(u, v)), acc).otherwise(F.concat(acc, F.array(u))))
    rest = lambda kept: F.concat(kept, F.filter(units, lambda u: ~known(u) & single(u) & ~F.exists(kept, lambda v: ~single(v) & meets(u, v))))
    return _let(_let(taken(lines), rest), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(units))


def notices(text: Column, model: Model) -> Column:
    """array<struct<place, family, probability, borne_out>> of a text: its notices by place."""
    may = _may_be_licence(model)

    def of_block(b: Column) -> Column:
        judged = F.filter(F.transform(_units(b["tokens"], b["first"], may), lambda u: _judged(u, model)), lambda u: u.isNotNull())
        return F.when(may(F.flatten(b["tokens"])), _let(judged, _settled))

    found = F.flatten(F.filter(F.transform(_blocks(F.lower(F.coalesce(text.cast("string"), F.lit("")))), of_block), lambda x: x.isNotNull()))
    return F.array_sort(F.transform(found, lambda u: F.struct(u["place"].alias("place"), u["family"].alias("family"), F.round(u["probability"], 6).alias("probability"), F.round(u["borne_out"], 6).alias("borne_out"))))


def licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_notices, families (in order of name), notices (place of the first line, family, probability, borne_out) of each row of ``docs`` (doc_id, text).

    Notices are lines of a text, or runs of lines without a blank one between. A null or empty text has none; rows that
    repeat each other are judged apart and alike; a text of any length is read whole; an empty table gives no rows; other
    columns, whatever their names, are ignored. Each row is judged by itself: nothing is shuffled.
    """
    found = docs.select("doc_id", notices(F.col("text"), model or train()).alias("notices"))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.col("notices.family"))).alias("families"), "notices")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    C.shared_dir(spark)
    return licences(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
