"""Each text operator over nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names."""

from collections import Counter

import pytest

import corpus_pipeline
from vigilake.llm import decontam, license, linededup, packing, pii, quality, simhash, toxicity
from vigilake.llm.queries import tokenizer_path

LONG = "\n".join(f"line {k} of a very long text has its own words w{k} x{k * 7} y{k * 13}" for k in range(6_000))
NOTICE = "Released under the MIT License.\n"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "s", 50), (1, "one two three four five six seven eight nine ten eleven", "en", "s", 50),
    (None, "a text without an id but with words enough to stay in the corpus here", None, None, None), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, LONG + "\n" + NOTICE, "en", "s", len(LONG)),
    (4, "another text of the same document id with quite a few words in one line", "de", None, 5),
]
#: Columns that operators make or use inside.
CLASH = ["kept", "row", "id", "h", "n", "Kinds", "fp", "root", "k1", "score", "license", "start", "host"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *[F.lit("mine").alias(c) for c in CLASH]).cache()


def ids(rows):
    return Counter(r.doc_id for r in rows)


ALL = Counter(r[0] for r in ROWS)


def test_line_dedup(docs):
    got = linededup.dedup_lines(docs).collect()
    assert ids(got) == ALL and all(r.k1 == r.row == "mine" for r in got)
    assert [r.n_lines for r in got if r.text is not None and r.text.startswith("line 0")] == [6002]


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert ids(got) == ALL and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and ids(kept.collect()) == Counter({1: 1, None: 1, 2: 1, 4: 2})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination(docs, spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, "own words w5999 x41993 y77987 released under the mit license"), (None, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")
    found = decontam.find_leaks(docs, items.select("*", F.lit("mine").alias("h"))).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(4, 1), (1, None)}
    assert ids(decontam.decontaminate(docs, items).collect()) == Counter({None: 1, 2: 1, 3: 1})


def test_pseudonyms(docs):
    got = pii.pseudonymise(docs, "key").collect()
    assert ids(got) == ALL and all(r.n_replaced == 0 and r.kinds == [] for r in got)


def test_licenses(docs):
    got = license.scan_licenses(docs.unionAll(docs.where("doc_id = 4").withColumn("doc_id", docs["doc_id"] * 0 + 9))).collect()
    assert ids(got) == Counter({4: 1, 9: 1}) and {r.license for r in got} == {"MIT"}
    assert license.scan_licenses(docs.limit(0)).count() == 0


def test_toxicity(docs):
    model = toxicity.Model((("words ", 4.0),), (), (-3.0, 3.0, 1.0))
    got = toxicity.score(docs, model).collect()
    assert ids(got) == ALL
    assert {r.predicted for r in got if r.doc_id in (2, 3)} == {0} and {r.predicted for r in got if r.doc_id is None} == {1}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality(docs):
    got = quality.measure(docs).collect()
    assert ids(got) == ALL and {r.n_words for r in got if r.doc_id in (2, 3)} == {0}
    judged = quality.judge(docs)
    # the very long text says the same words in each line
    assert ids(judged.where("kept").collect()) == Counter({1: 2, None: 1, 4: 1}) and judged.columns[-1] == "kept"


def test_the_order_of_rules_is_stable(docs):
    orders = {tuple(r.name for r in quality.order_rules(docs)) for _ in range(4)}
    assert len(orders) == 1


def test_packing(docs):
    got = packing.pack(docs, tokenizer_path()).collect()
    # rows of one id and of none are documents each
    assert sum(r.length for r in got if r.doc_id in (2, 3)) == 2
    whole = Counter()
    for r in got:
        whole[r.doc_id, r.doc_tokens] += r.length
    assert all(n % size == 0 for (_, size), n in whole.items()) and whole[1, got[[x.doc_id for x in got].index(1)].doc_tokens] > 0
    assert sum(n // size for (_, size), n in whole.items()) == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(name, spark):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = stage(spark, rows, "/root/testdata/sf0.001")
    assert got.count() > 0 and (name == "packing" or got.columns == rows.columns)
    assert stage(spark, rows.limit(0), "/root/testdata/sf0.001").count() == 0
