"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded first: lower case, homoglyphs and digits that stand for letters become those letters, all else but
letters and digits becomes a space. The lexicon holds words and word beginnings with weights, and exception phrases in
which a match doesn't count; both are learned from labelled texts, or given. The score is a logistic of the matched
weight as such and as a share of the text's length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows at most that the lexicon and the score are fitted on; a larger table is sampled by a hash.
TRAIN_ROWS = 10_000
#: Lengths of word beginnings that can become entries.
STEMS = (4, 5, 6)
#: An entry's least toxic texts (and share of all toxic ones), and the least log ratio of its rates.
LEAST_TEXTS, LEAST_SHARE, LEAST_WEIGHT = 5, 0.004, 2.5
#: Clean texts in which a phrase around an entry must stand, with no toxic one, to be an exception.
EXCEPTION_TEXTS = 3

# Letters of other scripts (Cyrillic, Greek, Latin extensions), digits and signs that pass for Latin letters,
# after compatibility forms (full-width and mathematical letters and the like) have become plain ones.
_LOOKALIKES = {
    "a": "аαɑ4@", "b": "вβьƅ8", "c": "сϲᴄ", "d": "ԁɗ", "e": "еєεҽ3", "f": "ғƒ", "g": "ɡց9", "h": "һнћ", "i": "іιɩıї1!|", "j": "јϳ",
    "k": "кκᴋ", "l": "ӏⅼ", "m": "мᴍ", "n": "ոпηᴎ", "o": "оοσօө0", "p": "рρ", "q": "ԛգ", "r": "гᴦ", "s": "ѕꜱ5$", "t": "тτᴛ7", "u": "υսᴜц",
    "v": "ѵνᴠ", "w": "ԝωɯшᴡ", "x": "хχ×", "y": "уүγʏ", "z": "ᴢʐ2",
}
_FOLD = str.maketrans({sign: letter for letter, signs in _LOOKALIKES.items() for sign in signs})
_OTHER = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded text, its words between single spaces, with a space at both ends."""
    plain = text or ""
    if not plain.isascii():
        plain = unicodedata.normalize("NFKC", plain)
    return f" {_OTHER.sub(' ', plain.lower().translate(_FOLD)).strip()} "


@dataclass(frozen=True)
class Model:
    """Entries (folded; a trailing space asks for the whole word) with weights, phrases that cancel them, and the
    score's coefficients: constant, log of the weight matched, weight matched for each word."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-2.0, 0.0, 0.0)


@cache
def _automaton(model: Model) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in model.exceptions:
        found.add_word(phrase, (len(phrase), None))
    for entry, weight in model.entries:
        found.add_word(f" {entry}", (len(entry) + 1, weight))
    if len(found):
        found.make_automaton()
    return found


def matched(model: Model, text: str | None) -> tuple[float, int]:
    """The weight of the entries that the text holds outside exception phrases, and its words."""
    folded = fold(text)
    automaton = _automaton(model)
    hits, safe = [], []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            (safe if weight is None else hits).append((end - length + 1, end, weight or 0.0))
    # phrases by start, with the farthest end of each and those before it: one that starts in time covers a hit if any does
    safe.sort()
    starts, reach = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
    total = 0.0
    for start, end, weight in hits:
        k = bisect_right(starts, start)
        # one white space belongs to two neighbours, so phrases may share their ends
        if not k or end > reach[k - 1] + 1:
            total += weight
    return total, len(folded.split())


def _inputs(model: Model, text: str | None) -> tuple[float, float]:
    weight, n = matched(model, text)
    return math.log1p(weight), weight / max(n, 1)


def _score(model: Model, text: str | None) -> float:
    a, b, c = model.coefficients
    x, y = _inputs(model, text)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _features(folded: str) -> set[str]:
    """The entries that a text could give: its words and their beginnings."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f"{w} ")
        out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


def _count(kind) -> object:
    """For each feature that `kind` finds in a folded text: texts by label, added up within batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                by[int(label)].update(kind(fold(text)))
            names = sorted(by[0] | by[1])
            counts = {"feature": names, "clean": [by[0][f] for f in names], "toxic": [by[1][f] for f in names]}
            yield pd.DataFrame(counts).astype({"feature": object, "clean": "int64", "toxic": "int64"})

    return run


def _phrases(entries: tuple[tuple[str, float], ...]):
    """Finder of entries with the word before or after them."""
    whole, stems = {e[:-1] for e, _ in entries if e[-1] == " "}, {e for e, _ in entries if e[-1] != " "}

    def find(folded: str) -> set[str]:
        ws, out = folded.split(), set()
        for k, w in enumerate(ws):
            if w in whole or any(w[:n] in stems for n in STEMS):
                if k:
                    out.add(f" {ws[k - 1]} {w} ")
                if k + 1 < len(ws):
                    out.add(f" {w} {ws[k + 1]} ")
        return out

    return find


def _choose(counts: DataFrame, toxic: int, clean: int) -> tuple[tuple[str, float], ...]:
    """The features whose rate among toxic texts is far above that among clean ones, words before their beginnings. A
    beginning must be as telling without the texts of the longer features that were chosen under it."""
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * toxic))

    def weigh(t: float, c: float) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    ratio = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    found = counts.where((F.col("toxic") >= least) & (ratio >= LEAST_WEIGHT))
    # as many as the fitted rows give; those are bounded
    rows = found.collect()
    count = {r["feature"]: (r["toxic"], r["clean"]) for r in rows}
    taken: Counter = Counter()  # texts of chosen features under a beginning, by (beginning, label)
    chosen = []
    for feature in sorted(count, key=lambda f: (-len(f), f)):
        t, c = count[feature]
        rest_t, rest_c = max(0, t - taken[feature, 1]), max(0, c - taken[feature, 0])
        if rest_t < least or weigh(rest_t, rest_c) < LEAST_WEIGHT:
            continue
        chosen.append((feature, round(weigh(rest_t, rest_c), 4)))
        for n in STEMS:
            if n < len(feature):
                taken[feature[:n], 1] += rest_t
                taken[feature[:n], 0] += rest_c
    return tuple(sorted(chosen))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a ridge penalty, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1]) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(ident: Column) -> Column:
    """Whether the id's text form has a CRC-32 that 5 divides; such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """A model from the labelled rows that aren't held out, at most `train_rows` of them, those of the lowest hash.

    Null ids and null labels teach nothing. Equal texts count once. Without labelled rows, or without entries that
    tell the classes apart, every score is the same and under one half. `train_rows` bounds what is learned from, and so
    the lexicon and its exceptions; nothing else does.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = chosen.where(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("label").isin(0, 1))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    train = texts.join(F.broadcast(chosen), "id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label").alias("label"))
    train = train.persist()
    try:
        totals = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic or not clean:
            return Model()
        schema = "feature string, clean long, toxic long"
        add = (F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        entries = _choose(train.mapInPandas(_count(_features), schema).groupBy("feature").agg(*add), toxic, clean)
        if not entries:
            return Model()
        phrases = train.mapInPandas(_count(_phrases(entries)), schema).groupBy("feature").agg(*add)
        safe = phrases.where((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_TEXTS))
        safe = [r["feature"] for r in safe.collect()]
        model = Model(entries, tuple(sorted(safe)))
        inputs = train.select(_inputs_column(model, F.col("text")).alias("x"), "label").select("x.*", "label").toPandas()
        beta = _fit(inputs[["x", "y"]].to_numpy(), inputs["label"].to_numpy())
        return Model(model.entries, model.exceptions, tuple(float(b) for b in beta))
    finally:
        train.unpersist()


def _inputs_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("struct<x: double, y: double>")
    def of(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_inputs(model, t) for t in column], columns=["x", "y"], dtype="float64")

    return of(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, held_out, score (0 to 1) and predicted (1 from one half on).

    Null and empty texts match nothing and get the score of a text without matches. Repeated rows are scored alike, a
    null id stays null and isn't held out, an empty table gives no rows; other columns aren't returned. Very long texts
    are matched whole, in time that grows with their length.
    """

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series([_score(model, t) for t in column], dtype="float64")

    ident = F.col(f"`{id_col}`")
    held = docs.select(
        ident.alias(id_col), held_out(ident).alias("held_out"), scored(F.col(f"`{text_col}`").cast("string")).alias("score")
    )
    return held.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
