"""Licence scans: lines of a text against licence notices by the Dice coefficient of their word bigrams.

A line and a notice are normalised to lower-case words and become sets of adjacent word pairs. With ``a`` and ``b`` pairs
of which ``c`` are common, Dice is ``2c / (a + b)``. Since ``c`` is at most the smaller number, a Dice of ``t`` needs
``t / (2 - t) <= a / b <= (2 - t) / t``: these bounds discard most notices before any pair is compared, and a line outside the bounds
of all notices, or without a pair of any notice, is dropped at once.

The notices are a fixed list, so they travel inside the expression. Everything happens in the row of the document: one
pass, no shuffle, no skew.

Defined cases: a null or empty text has no lines that match; its licence is null and its Dice 0. Among notices with equal Dice
the first name wins. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .decontaminate import terms

LEAST_DICE = 0.8
#: Notices by licence (fixed values, public wordings).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _pairs_of(notice: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _line_pairs(own: Column) -> Column:
    """Distinct adjacent pairs of words; the last word has no partner and drops out."""
    joined = F.zip_with(own, F.slice(own, 2, 2_000_000_000), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.array_distinct(joined))


def scanned(docs: DataFrame, notices=NOTICES, least: float = LEAST_DICE) -> DataFrame:
    """``docs`` with ``license`` (of the line with the highest Dice), ``dice``, ``n_license_lines``."""
    known = [(name, _pairs_of(text)) for name, text in notices]
    every = F.array(*[F.lit(p) for p in sorted({p for _, own in known for p in own})])
    low, high = least / (2 - least), (2 - least) / least
    small, large = min(len(p) for _, p in known) * low, max(len(p) for _, p in known) * high
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda line: _line_pairs(terms(line)))
    some = F.filter(lines, lambda own: F.size(own).between(small, large) & F.arrays_overlap(own, every))

    def dice(own: Column, notice: list[str]) -> Column:
        both = F.size(F.array_intersect(own, F.array(*[F.lit(p) for p in notice])))
        return F.when(F.size(own).between(len(notice) * low, len(notice) * high), both * 2.0 / (F.size(own) + len(notice)))

    def best(own: Column) -> Column:
        # Structs order by Dice first; the negated place lets the first notice win a tie.
        scored = [F.struct(F.coalesce(dice(own, p), F.lit(0.0)).alias("dice"), F.lit(-k).alias("place"), F.lit(name).alias("license")) for k, (name, p) in enumerate(known)]
        return F.array_max(F.array(*scored))

    rows = docs.withColumn("__some", some)
    rows = rows.withColumn("__found", F.filter(F.transform("__some", best), lambda x: x["dice"] >= least))
    top = F.array_max("__found")
    return rows.select(*docs.columns, top["license"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.size("__found").cast("long").alias("n_license_lines"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', {_pairs_of(text)!r})" for k, (name, text) in enumerate(NOTICES))
    return rf"""
with notices(place, license, pairs) as (values {rows}),
d as materialized (select row_number() over () as rid, doc_id, text from documents),
lines as (
  select rid, line_no, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select rid, unnest(parts) as line, generate_subscripts(parts, 1) as line_no
        from (select rid, string_split(text, chr(10)) as parts from d where text is not null))),
grams as (select distinct rid, line_no, w[i] || ' ' || w[i + 1] as pair from (select rid, line_no, w, unnest(range(1, len(w))) as i from lines)),
sizes as (select rid, line_no, count(*) as a from grams group by all),
commons as (
  select rid, line_no, place, license, n.b, count(*) as c from grams
  join (select place, license, len(pairs) as b, unnest(pairs) as pair from notices) n using (pair) group by all),
scored as (select rid, place, license, line_no, 2.0::double * c / (a + b) as dice from commons join sizes using (rid, line_no)),
good as (select rid, line_no, max(dice) as dice, arg_max(license, (dice, -place)) as license, max((dice, -place)) as rank from scored where dice >= {LEAST_DICE} group by rid, line_no),
best as (select rid, max(dice) as dice, arg_max(license, rank) as license, count(*) as n from good group by rid)
select doc_id, license, coalesce(dice, 0.0::double) as dice, coalesce(n, 0) as n_license_lines
from d left join best using (rid)
"""


ORACLE = _oracle()
