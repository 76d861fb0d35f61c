"""Phrases, min-max hashing and centroid clustering against brute force, and over odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from vigilake.llm import centroids, minhash, phrases, simhash

# ---------------------------------------------------------------- phrases


def brute_collocations(rows, min_count=10, percent=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        for p, a in candidates.items():
            cuts = [(math.floor(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = [b for q, b in candidates.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * b >= percent * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "York", "city", "a|b", "été", "\x1c", " x", "naïve", "7"]
    rows = []
    for _ in range(n):
        ws = rng.choices(vocabulary, [9, 3, 8, 4, 4, 3, 1, 2, 1, 1, 1, 2], k=rng.randrange(0, 30))
        rows.append((rng.choice(["  ", " ", "\t"]).join(w + rng.choice(["", "", "", ".", ",", "\n", "\x0b", "!?"]) for w in ws), rng.choice(["en", "fr", "und", None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"bits": 25}, {"top": 7}, {"min_count": 2, "inside_percent": 90}])
def test_collocations_match_brute_force(spark, options):
    rows = corpus(len(options) + 1) + [(None, "en"), ("", None), ("New york " * 40, "de"), ("x " * 30 + ".", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())
    known = {k: v for k, v in options.items() if k != "bits"}
    want = brute_collocations(rows, known.get("min_count", 10), known.get("inside_percent", 50), known.get("top", 2000))
    assert got == want and len(want) > 20


def test_collocations_over_blocks_and_cuts(spark, monkeypatch):
    """Narrow and wide keys count alike, and a cut text has the words of a whole one."""
    rows = corpus(9, 60)
    ids = np.array([3, 1, 0, 1, 3, 1, 2, 0, 5, 3, 1, 2])
    narrow, wide = phrases.pack(ids, 3), phrases.pack(ids, 30)
    assert sorted(narrow[2]) == sorted(wide[2]) and narrow[2].sum() == 7 + 4
    text = ". ".join(t for t, _ in rows).encode().translate(phrases.FOLD)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    parts = list(phrases.chunks(text))
    assert len(parts) > 10
    assert [w for p in parts for w in phrases.words_and_breaks(p) if w != b"."] == [w for w in phrases.words_and_breaks(text) if w != b"."]


def test_collocations_of_odd_tables(spark):
    schema = "text string, lang string, id long, `key` string, a int, n int, word string, block int"
    docs = spark.createDataFrame([("one two " * 12, None, k, "x", 1, 1, "w", 0) for k in (1, 1, None)], schema)
    got = phrases.collocations(docs).collect()
    assert {(r.lang, r.phrase, r.a) for r in got} == {("und", "one two one", 33), ("und", "two one two", 33)}
    assert all(r.n == 72 for r in got)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.withColumn("text", docs.key.cast("string").substr(5, 1))).count() == 0


def test_a_hot_phrase_over_many_tasks(spark):
    docs = spark.range(0, 4_000, 1, 16).selectExpr("'hot phrase here' AS text", "'en' AS lang")
    got = phrases.collocations(docs).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("hot phrase here", 4_000, 4_000, 4_000, 12_000, 1_000_000)]


# ---------------------------------------------------------------- min-max hashing


def shingles(text, size=2):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not ws:
        return frozenset()
    return frozenset(" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    lowest = {k: min(v) for k, v in members.items()}
    return sorted((d, len(s), lowest[find(k)], d == lowest[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_texts(seed, n):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 30, 120]))] for _ in range(25)]
    rows = []
    for k in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, len(ws) // 20, len(ws) // 10])):
            ws[rng.randrange(len(ws))] = f"v{rng.randrange(10_000)}"
        rows.append((1000 - k, (" " if k % 3 else "\t").join(w.upper() if k % 2 else w for w in ws)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_min_max_components_match_brute_force(spark, seed):
    rows = near_texts(seed, 500) + [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "One"), (10, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_blocks_of_a_hot_band_find_what_leads_miss(spark, monkeypatch):
    """A chain, of which only neighbours are alike, in groups that are split into parts."""
    monkeypatch.setattr(minhash, "GROUP_SETS", 16)
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(120)] + [(k + 500, " ".join(words[4 * k : 4 * k + 60])) for k in range(0, 120, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_bands_miss_few_pairs():
    """Pairs at the similarity share a band, and agree in the values that the estimate asks for."""
    rng = np.random.default_rng(3)
    least, missed = minhash.least_agreeing(0.8), 0
    for n in (4, 8, 40, 400):
        for _ in range(100):
            both, rest = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
            x, y = minhash.min_max(np.concatenate([both, rest])), minhash.min_max(both)
            agree = (np.concatenate(x) == np.concatenate(y)).sum()
            missed += not set(minhash.banded(*x)) & set(minhash.banded(*y)) or agree < least
    assert missed == 0


def test_min_max_of_odd_tables(spark):
    schema = "doc_id long, text string, n int, sid long, kept string, key string, root long"
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "a b c d e f", 1, 1, "x", "y", 0), (1, "a b c d e f", 1, 1, "x", "y", 0), (None, "a b c d e f", 0, 0, "", "", 0), (None, "alone here", 0, 0, "", "", 0), (None, None, 0, 0, "", "", 0), (1, "another text of one id", 0, 0, "", "", 0), (3, long, 0, 0, "", "", 0), (2, long + " end", 0, 0, "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == Counter({(1, 5, 1, True): 2, (None, 5, 1, False): 1, (None, 1, None, True): 1, (None, 0, None, True): 1, (1, 4, 1, True): 1, (3, 199_999, 2, False): 1, (2, 200_000, 2, True): 1})
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert len(np.unique(simhash.shingle_hashes(long, 2))) == 199_999


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middles = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v):
        return min((far(v, c), n) for n, c in enumerate(middles))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        middles = [[sum(x) // len(of[n]) for x in zip(*of[n], strict=True)] if of[n] else c for n, c in enumerate(middles)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in last)


def vectors(seed, n, spread=0.05, grid=False):
    rng = np.random.default_rng(seed)
    bases = rng.normal(0, 1, (12, 64))
    made = bases[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, 64))
    if grid:
        made = rng.integers(-1, 2, (n, 64)) / 64 * (rng.random((n, 64)) < 0.05)
    return [(k, v) for k, v in enumerate(made.astype(np.float32).tolist())]


@pytest.mark.parametrize("rows", [vectors(1, 900), vectors(2, 500, 2.0), vectors(3, 600, grid=True), vectors(4, 9), [(k, [3.0e4 * (-1) ** (k + j) + k for j in range(64)]) for k in range(40)]])
def test_clusters_match_brute_force(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = Counter(tuple(r) for r in centroids.cluster(table).collect())
    assert got == brute_clusters(exact)


def test_balls_leave_out_only_what_is_farther():
    rng = np.random.default_rng(5)
    whole = rng.integers(-40, 40, (3, 64))[rng.integers(0, 3, 3_000)] + rng.integers(-2, 3, (3_000, 64))
    order, balls = centroids.build_tree(whole)
    rows, middles = whole[order], np.stack([whole[0], whole[5], whole[9], whole[9] + 1])
    cluster, by_ball = np.full(len(rows), -1), 0
    for lo, hi, own, ball in centroids.assigned(rows, balls, middles):
        cluster[lo:hi] = own
        if ball is not None:
            by_ball += hi - lo
            assert (balls["sums"][ball] == rows[lo:hi].sum(axis=0)).all()
    want = ((rows[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (cluster == want).all() and by_ball > 500


def test_clusters_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(6, 30)
    rows = good + good[:5] + [(None, good[0][1]), (None, good[1][1]), (100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 63 + [None]), (104, [nan] * 64), (105, [inf] + [0.0] * 63), (106, [0.0] * 65)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, n int")
    exact = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    assert Counter(tuple(r) for r in centroids.cluster(table).collect()) == brute_clusters(exact)
    assert centroids.cluster(table.where("vec_id >= 100")).count() == centroids.cluster(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()
