"""Quality rules as a short-circuit cascade.

Each rule is a predicate over a few features of one text. What a rule costs and how many rows it rejects is
estimated on a bounded sample; the rules then run in the order of rejection per cost inside one CASE, so a row that
a cheap rule rejects never pays for a dear one. The order changes the work and never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.text import filled, let, lines, replace_columns, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition count.
WINDOW = 5
#: Rows at most on which costs and selectivities are estimated, and the share of rows drawn to find them.
SAMPLE_ROWS, SAMPLE_SHARE = 400, 0.02


def _windows(ws: Column, make: Callable[[Column], Column]) -> Column:
    """`make(start)` for the start of every window of WINDOW words; needs that many words."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), make)


def _covered(starts: Column) -> Column:
    """Words that lie in at least one of the windows with these sorted starts."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(
        s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")
    )
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of five that occurs twice or more in the text, the first occurrence included.

    Distinct hashes prove that no window repeats; only a text with two equal hashes compares the windows themselves.
    """
    hashes = _windows(ws, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    spelled = F.array_sort(
        _windows(ws, lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i + 1, WINDOW)).alias("g"), i.alias("i")))
    )
    twice = lambda s: F.filter(
        s,
        lambda x, k: (F.get(s, k - 1)["g"] == x["g"]).eqNullSafe(True)
        | (F.get(s, k + 1)["g"] == x["g"]).eqNullSafe(True),
    )
    exact = let(spelled, lambda s: _covered(F.array_sort(F.transform(twice(s), lambda x: x["i"]))))
    found = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact),
    )
    return F.when(F.size(ws) <= WINDOW, F.lit(0).cast("long")).otherwise(found)


def features(text: Column, ws: Column) -> dict[str, Column]:
    """The features rules draw on. `ws` must be `words(text)`, bound once for the row."""
    t = F.coalesce(text, F.lit(""))
    with_word = F.filter(lines(text), filled)
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"),
        "n_lines": F.size(with_word).cast("long"),
        "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(ws),
    }


@dataclass(frozen=True)
class Rule:
    """A named predicate over features that holds for rows to reject, and the features that it pays for: words are
    counted once for all rules."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    uses: tuple[str, ...] = ()


#: What a feature costs: for each character, word and line of a text, in nanoseconds as measured once on long texts. They
#: weigh counts taken from the sample, so that the order depends on the rows alone and never on how busy a machine is.
COSTS = {
    "word_chars": (1.0, 20.0, 0.0),
    "n_symbols": (6.0, 0.0, 0.0),
    "n_lines": (2.0, 0.0, 100.0),
    "n_dup_lines": (4.0, 0.0, 250.0),
    "n_repeat_words": (0.0, 900.0, 0.0),
}
#: What any rule costs for a row.
BASE_COST = 50.0


#: The base rules, whose rejections stand by themselves.
BASE_RULES = (
    Rule("too_few_words", lambda f: f["n_words"] < 10),
    Rule("repeats_itself", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"], ("n_repeat_words",)),
)
#: Further rules: over one symbol in ten words, over half of the lines repeated, mean word length out of 2 to 15.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"], ("n_symbols",)),
    Rule("duplicate_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"], ("n_dup_lines", "n_lines")),
    Rule("word_length", lambda f: ~f["word_chars"].between(2 * f["n_words"], 15 * f["n_words"]), ("word_chars",)),
)


def _rejected(rule: Rule, text: Column) -> Column:
    return let(words(text), lambda ws: rule.rejects(features(text, ws)))


def order_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """The rules by rejection per cost, best first, as one job counts them on at most `sample_rows` rows; at equal rates
    in the given order. A feature without an entry in COSTS costs as much as the dearest.

    The sample is drawn by `take`, which stops reading once it has its rows, so it comes from the table's first files:
    another order costs time and changes no verdict. An empty table keeps the given order.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    chosen = F.pmod(F.xxhash64("text"), F.lit(round(1 / SAMPLE_SHARE))) == 0  # by the text, whatever the partitions are
    drawn = docs.select(text).where(chosen).take(sample_rows) or docs.select(text).take(sample_rows)
    if not drawn:
        return list(rules)
    sample = docs.sparkSession.createDataFrame(drawn, "text string").repartition(1)
    sizes = [F.sum(F.length("text")), F.sum(F.size(words(F.col("text")))), F.sum(F.size(lines(F.col("text"))))]
    verdicts = [F.count_if(_rejected(rule, F.col("text"))) for rule in rules]
    counts = sample.agg(*[c.alias(f"c{k}") for k, c in enumerate([*sizes, *verdicts])]).first()
    size, rejected = [n or 0 for n in counts[:3]], counts[3:]
    dearest = tuple(max(c) for c in zip(*COSTS.values(), strict=True))

    def cost(rule: Rule) -> float:
        per = [COSTS.get(f, dearest) for f in rule.uses]
        return BASE_COST * len(drawn) + sum(w * n for c in per for w, n in zip(c, size, strict=True))

    return sorted(rules, key=lambda rule: -(rejected[rules.index(rule)] + 0.5) / cost(rule))


def cascade(rules: Sequence[Rule], f: dict[str, Column]) -> Column:
    """True for rows that no rule rejects; later rules aren't evaluated for a row once one rejects it."""
    verdict = F.when(rules[0].rejects(f), F.lit(False))
    for rule in rules[1:]:
        verdict = verdict.when(rule.rejects(f), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", order: Sequence[Rule] | None = None
) -> DataFrame:
    """`docs` with `kept`: whether no rule rejects the row.

    Null and empty texts have no words and are rejected by `too_few_words`. Repeated rows each get their verdict, an
    empty table stays empty, very long texts are read whole, and an input column named `kept` is replaced.
    """
    order = order or order_rules(docs, rules, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    # bound inside the expression: as a column of its own, the words would be taken anew for each use in a filter
    return replace_columns(docs, {"kept": let(words(text), lambda ws: cascade(order, features(text, ws)))})


def measure(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: Sequence[Rule] | None = None,
) -> DataFrame:
    """Per row: its id, every feature, `base_failed` and `kept`; here the features are wanted for every row.

    Null and empty texts have no words; repeated rows and null ids give a row each; other columns aren't returned.
    """
    order = order or order_rules(docs, rules, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    found = let(words(text), lambda ws: F.struct(*[v.alias(k) for k, v in features(text, ws).items()]))
    held = docs.select(F.col(f"`{id_col}`").alias("id"), found.alias("found")).select("id", "found.*")
    f = {k: F.col(k) for k in held.columns if k != "id"}
    base = BASE_RULES[0].rejects(f) | BASE_RULES[1].rejects(f)
    return held.select(
        F.col("id").alias(id_col), *f.values(), base.alias("base_failed"), (~base & cascade(order, f)).alias("kept")
    )
