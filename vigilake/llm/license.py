"""Licence scan: known licence sentences, then ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm import license_table
from vigilake.llm.text import let


class LicenseRule(NamedTuple):
    """Holds where the sentence identifiers occur in this order, in sentences at most `gap` apart."""

    license: str
    sentences: tuple[str, ...]
    gap: int = 3


#: Known licence sentences in normal form (lower case, words of letters, digits and dots), by identifier.
SENTENCES = {
    "apache-2-short": "licensed under the apache license version 2.0",
    "apache-2-grant": "you may not use this file except in compliance with the license",
    "mit-short": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "gpl-3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-3-later": "either version 3 of the license or at your option any later version",
    "gpl-share": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-nc-4-short": "licensed under cc by nc 4.0",
    "cc-by-4-short": "licensed under cc by 4.0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Further known sentences, as the licences and their standard headers have them, with the identifier that each counts as.
VARIANTS = license_table.SENTENCES | {
    "licensed under the apache license version 2.0 the license": "apache-2-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-header",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-share",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
}
#: Rules in order of precedence: a rule's sentences are no longer free for the rules after it.
RULES = (
    *[LicenseRule(license, ids) for license, ids in license_table.RULES],
    LicenseRule("GPL-3.0-or-later", ("gpl-share", "gpl-3-later")),
    LicenseRule("GPL-3.0-or-later", ("gpl-3-header",)),
    LicenseRule("GPL-2.0-or-later", ("gpl-share", "gpl-2-later")),
    LicenseRule("GPL-2.0-or-later", ("gpl-2-header",)),
    LicenseRule("GPL-3.0-only", ("gpl-3-short",)),
    LicenseRule("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse"), 8),
    LicenseRule("BSD-2-Clause", ("bsd-redistribution",)),
    LicenseRule("MIT", ("mit-grant", "mit-notice")),
    LicenseRule("MIT", ("mit-grant",)),
    LicenseRule("MIT", ("mit-short",)),
    LicenseRule("Apache-2.0", ("apache-2-short", "apache-2-grant")),
    LicenseRule("Apache-2.0", ("apache-2-short",)),
    LicenseRule("CC-BY-NC-4.0", ("cc-by-nc-4-short",)),
    LicenseRule("CC-BY-4.0", ("cc-by-4-short",)),
    *[LicenseRule(x, (f"notice:{x}",)) for x in license_table.NAMES],
    *[LicenseRule(x, (f"tag:{x}",)) for x in (*license_table.NAMES, *license_table.TAGS)],
)
#: Words that sentences of licences have and few others; a sentence is looked up only where one of them, or its own
#: longest word, stands.
MARKS = ("spdx", "license", "licence", "licensed", "unlicense", "copyright", "mozilla", "gnu", "contributors", "unencumbered", "eclipse", "mpl", "apache", "permission")

#: Where a sentence ends: a line end, or a stop before white space or the end of the text.
SENTENCE_END = r"\n|[.;!?](?=\s|$)"
#: A line end at which a sentence goes on: after a word, comma or bracket, and before a line that starts with a word (after
#: a comment's marks) and isn't a numbered item. Joined sentences hold WRAP in its place.
WRAP = "\x01"
WRAPPED = r"""(?<=[\p{L}\p{N},)"'\]][ \t\r]{0,4})\n(?=[^\p{L}\p{N}\n]{0,12}(?:\p{L}|\p{N}+(?:\.\p{N}+)*[\s,(]))"""


HITS = "array<struct<license:string,first_sentence:int,last_sentence:int,sentence_ids:array<string>>>"


def normal_form(sentence: Column) -> Column:
    """Lower case; runs of anything but letters, digits and inner dots become one space."""
    stops = F.regexp_replace(F.lower(sentence), r"\.(?!\p{N})|(?<!\p{N})\.", " ")
    return F.trim(F.regexp_replace(stops, r"[^\p{L}\p{N}.]+", " "))


def scan_licenses(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: Sequence[LicenseRule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    variants: dict[str, str] = VARIANTS,
    patterns: dict[str, str] = license_table.PATTERNS,
) -> DataFrame:
    """Per licence and place found: id, license, first and last sentence number (from 0), and sentence_ids.

    A sentence is known where its normal form is one of `sentences` or `variants`, is a notice or tag that names a licence
    of license_table, or fits one of `patterns`; what precedes or follows it in the same line
    after a stop is another sentence. Every line end counts as one in the numbers; a known sentence may also be wrapped
    over lines, and has the number of its first line. A rule's gap counts whole sentences that have a letter. Rules run in order over a document's known sentences; each takes the earliest
    free run of its identifiers, again and again, until it finds none. Null and empty texts, and texts without a known
    sentence, give no row. Repeated rows give a row each; a null id stays null; other columns aren't returned.

    The known sentences are a fixed list, so they go into the plan as a literal map. Everything is done within the
    row: a text is never exploded or shuffled, and texts with no sentence that could be known drop out at one scan.
    """
    known = F.create_map(*[F.lit(x) for pair in sorted({**{s: k for k, s in sentences.items()}, **variants}.items()) for x in pair])
    text = F.col(f"`{text_col}`").cast("string")
    held = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    # what patterns with placeholders say beside these
    hint = _hint([*sentences.values(), *variants, "spdx", *[re.sub(r"\(.*?\)\??|[.?{}\d,]+", " ", p) for p in patterns]])
    held = held.where(F.col("text").rlike(hint))
    held = held.select("id", F.split(F.regexp_replace("text", WRAPPED, WRAP), SENTENCE_END).alias("parts"))
    held = held.select("id", _recognised("parts", known, hint, patterns))
    return _apply_rules(held.where(F.size("free") > 0), rules).select(
        F.col("id").alias(id_col), "hit.license", "hit.first_sentence", "hit.last_sentence", "hit.sentence_ids"
    )


def _hint(sentences: list[str]) -> str:
    """A pattern that finds something in every known sentence, one of its MARKS as a whole word or its longest word, and in
    every notice."""
    marks = {next((m for m in MARKS if m in s.split()), max(s.split(), key=len)) for s in sentences}
    notice = rf"(?:{'|'.join(b.split()[0] for b in license_table.BEGINNINGS)})[^\p{{L}}\p{{N}}]+under"
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join([*sorted(re.escape(m) for m in marks), notice]) + r")(?![\p{L}\p{N}])"


def _recognised(parts: str, known: Column, hint: str, patterns: dict[str, str]) -> Column:
    """The known sentences of an array of joined sentences, in order, as (at, s, no): the number of the first line or
    sentence, the identifier, and the number of whole sentences with a letter before it."""
    none = F.array().cast("array<struct<at:int,s:string,no:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("no"), none.alias("free"))

    def name(normal: Column) -> Column:
        fitting = [F.when(normal.rlike(f"^(?:{p})$"), F.lit(s)) for p, s in patterns.items()]
        notice = F.try_element_at(named_by(license_table.names()), F.regexp_extract(normal, license_table.NOTICE, 1))
        tag = F.try_element_at(named_by(license_table.tags()), F.regexp_extract(normal, license_table.TAG, 1))
        return F.coalesce(F.try_element_at(known, normal), notice, tag, *fitting)

    def named_by(names: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])

    def named(acc: Column, joined: Column) -> Column:
        hit = lambda x, at: let(normal_form(x), lambda n: F.struct(at.cast("int").alias("at"), name(n).alias("s"), acc["no"].alias("no")))
        lines = F.transform(F.split(joined, WRAP), lambda x, i: hit(x, acc["at"] + i))
        whole = F.filter(F.array(hit(joined, acc["at"])), lambda x: x["s"].isNotNull())
        lines = F.when(F.size(whole) > 0, whole).otherwise(F.filter(lines, lambda x: x["s"].isNotNull()))
        return F.when(joined.rlike(hint), lines).otherwise(none)

    def step(acc: Column, joined: Column) -> Column:
        return F.struct(
            (acc["at"] + F.size(F.split(joined, WRAP))).cast("int").alias("at"),
            (acc["no"] + joined.rlike(r"\p{L}").cast("int")).cast("int").alias("no"),
            F.concat(acc["free"], named(acc, joined)).alias("free"),
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["free"]).alias("free")


def _apply_rules(held: DataFrame, rules: Sequence[LicenseRule]) -> DataFrame:
    """Rows (id, hit) from rows (id, free: array of (at, s, no) in text order): one fold over the rules within the row."""
    listed = F.array(
        *[
            F.struct(
                F.lit(r.license).alias("license"),
                F.array(*[F.lit(s) for s in r.sentences]).alias("sentences"),
                F.lit(r.gap).alias("gap"),
            )
            for r in rules
        ]
    )
    zero = F.struct(F.col("free"), F.array().cast(HITS).alias("hits"))

    def apply(acc: Column, rule: Column) -> Column:
        return let(
            _runs(acc["free"], rule),
            lambda runs: F.struct(
                F.filter(acc["free"], lambda x: ~F.array_contains(F.flatten(runs), x["at"])).alias("free"),
                F.concat(acc["hits"], _hits(runs, rule)).alias("hits"),
            ),
        )

    hits = F.aggregate(listed, zero, apply, lambda acc: acc["hits"])
    return held.select("id", F.explode(hits).alias("hit"))


def _hits(runs: Column, rule: Column) -> Column:
    return F.transform(
        runs,
        lambda run: F.struct(
            rule["license"].alias("license"),
            F.get(run, F.lit(0)).alias("first_sentence"),
            F.element_at(run, -1).alias("last_sentence"),
            rule["sentences"].alias("sentence_ids"),
        ),
    )


def _runs(free: Column, rule: Column) -> Column:
    """The disjoint runs of the rule's identifiers, as arrays of sentence numbers, in one pass over the row."""
    none = F.array().cast("array<int>")
    zero = F.struct(none.alias("open"), F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("done"))
    wanted = lambda k: F.get(rule["sentences"], k)

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["open"])
        fresh = (n > 0) & (x["no"] - acc["last"] <= rule["gap"])
        grown = (
            F.when(fresh & (x["s"] == wanted(n)), F.concat(acc["open"], F.array(x["at"])))
            .when(x["s"] == wanted(F.lit(0)), F.array(x["at"]))
            .when(fresh, acc["open"])
            .otherwise(none)
        )
        goes_on = fresh & (x["s"] != wanted(n)) & (x["s"] != wanted(F.lit(0)))
        last = F.when(goes_on, acc["last"]).otherwise(x["no"])
        return let(
            grown,
            lambda g: F.when(
                F.size(g) == F.size(rule["sentences"]),
                F.struct(none.alias("open"), last.alias("last"), F.concat(acc["done"], F.array(g)).alias("done")),
            ).otherwise(F.struct(g.alias("open"), last.alias("last"), acc["done"].alias("done"))),
        )

    return F.aggregate(free, zero, step, lambda acc: acc["done"])
