"""Cases of the fourth review: each failed before its finding was settled."""

from types import SimpleNamespace

import pytest


def test_pseudonyms_without_a_key_run_on_a_cluster():
    from vigilake.llm import queries

    session = lambda master, **conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.warns(UserWarning, match="can't be undone"):
        drawn = queries.pii_key(session("spark://host:7077"))
    with pytest.warns(UserWarning, match="everybody knows"):
        known = queries.pii_key(session("local[2]"))
    with pytest.warns(UserWarning):
        assert queries.pii_key(session("spark://host:7077")) == drawn  # one key for all of a process's texts
    assert drawn != known and len(drawn) == 64
    assert queries.pii_key(session("spark://host:7077", **{"spark.vigilake.pii.key": "mine"})) == "mine"


def test_trackers_side_by_side_are_trackers_of_their_own():
    import time

    import numpy as np
    import pyarrow as pa

    from vigilake.operators import tracking

    draw = np.random.default_rng(5)
    box = pa.struct([(c, pa.int32() if c == "class_id" else pa.float64()) for c in tracking._KEPT])
    numbers = [("generation", pa.int64()), ("pts_ns", pa.int64()), ("width", pa.int32()), ("height", pa.int32())]
    schema = pa.schema([("source_id", pa.string()), *numbers, ("detections", pa.list_(box)), ("warp", pa.list_(pa.float64()))])

    def frame(lane: int, k: int) -> dict:
        """Boxes on a coarse grid, so that costs tie; a new size, a null one, frames without boxes, and warps."""
        boxes = [
            {"class_id": int(draw.integers(0, 2)), "confidence": float(draw.choice([0.05, 0.3, 0.65, 0.8, 0.95])), "x1": x, "y1": y, "x2": x + 0.25, "y2": y + 0.3}
            for x, y in (draw.integers(0, 12, (draw.integers(0, 8), 2)) / 20).tolist()
        ]
        wide = 320 if lane == 2 and k > 40 else None if lane == 3 and k > 70 else 640
        warp = [1.0, 0.01, 2.0, -0.01, 1.0, 1.0] if lane == 1 and k % 3 == 0 else None
        return {"source_id": str(lane), "generation": 1, "pts_ns": k, "width": wide, "height": 360, "detections": boxes if k % 11 else None, "warp": warp}

    for settings, n in ((tracking.Settings(by_class=True), 8), (tracking.Settings(buffer=5), 64)):
        films = [[frame(lane, k) for k in range(100 + lane % 7)] for lane in range(n)]
        place = draw.permutation(n)  # lanes begin at other steps, and their rows stand in any order within one
        rows = sorted(((k + lane % 5, draw.random(), int(place[lane]), r) for lane, film in enumerate(films) for k, r in enumerate(film)), key=lambda x: x[:2])
        lanes, got, began = tracking.Lanes(settings), {}, time.perf_counter()
        for _ in films:
            lanes.opened(tracking.Frames(settings))
        for a in range(0, len(rows), 1_000):  # a step may be in two batches
            part = rows[a : a + 1_000]
            cuts = [0, *[i for i in range(1, len(part)) if part[i][0] != part[i - 1][0]], len(part)]
            told, exact = lanes.told(pa.RecordBatch.from_pylist([r for *_, r in part], schema), np.array([x[2] for x in part]), cuts, lambda a, b: None)
            got |= {(r["source_id"], r["pts_ns"]): (r, e) for r, e in zip(told.to_pylist(), exact.tolist(), strict=True)}
        together, began = time.perf_counter() - began, time.perf_counter()
        for lane, film in enumerate(films):
            own = tracking.Frames(settings)
            told, exact = own.told(pa.RecordBatch.from_pylist(film, schema))
            assert {(r["source_id"], r["pts_ns"]): (r, e) for r, e in zip(told.to_pylist(), exact, strict=True)}.items() <= got.items()
            state = lanes.frames_of(int(place[lane]))
            assert (state.digest(), state.names(), state.exact, state.shape) == (own.digest(), own.names(), own.exact, own.shape)
        assert n < 64 or together < (time.perf_counter() - began) / 2, together


def test_all_suffixes_of_articles_are_counted_over_the_host(spark, monkeypatch):
    import random
    from collections import Counter

    from vigilake.llm import html

    draw = random.Random(4)
    words = lambda n: " ".join(f"w{draw.randrange(9_000)}" for _ in range(n))
    told, half, quoted = [words(12) for _ in range(4)], words(14), words(15)
    pages, texts = [], {}

    def add(host, blocks, times=1):
        for _ in range(times):
            texts[len(pages)] = (host, blocks)
            pages.append((len(pages), f"http://{host}/{len(pages)}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))

    for host, n in (("large.example", 64), ("small.example", 21), ("none.example", 19)):
        for k in range(n):
            # between what is the same stands what no other page has, so that the least rank of the block is seldom shared
            notice = " ".join(f"{x} {host}{k}n{j}" for j, x in enumerate(told))
            blocks = [words(90), words(120), notice, words(60), *[half] * (2 * k < n), *[quoted] * (2 * k < n - 3), "Short."]
            add(host, blocks, 40 if k == n - 1 else 1 + k % 2)

    def brute() -> dict:
        found = {}
        for host in {h for h, _ in texts.values()}:
            different = {tuple(b) for h, b in texts.values() if h == host}
            runs = lambda b: set(zip(*[(ts := " ".join(b).split())[j:] for j in range(8)], strict=False))
            counts = Counter(r for b in different for r in runs(b))
            site = {r for r, c in counts.items() if len(different) >= 20 and c >= len(different) / 2}
            for k, (h, b) in texts.items():
                if h == host:
                    ts, at, kept = " ".join(b).split(), 0, []
                    covered = [any(tuple(ts[j : j + 8]) in site for j in range(max(0, i - 7), i + 1)) for i in range(len(ts))]
                    for block in b:
                        n = len(block.split())
                        if sum(covered[at : at + n]) < 0.8 * n:
                            kept.append(block)
                        at += n
                    found[k] = "\n\n".join(b if sum(covered) > 0.25 * len(ts) else kept)
        return found

    want = brute()
    cut = [k for k, (h, b) in texts.items() if want[k] != "\n\n".join(b)]
    assert {texts[k][0] for k in cut} == {"large.example", "small.example"} and len(cut) > 100
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    # a host's pages in few and in many parts, in tasks of many pages and of single ones
    for parts, most, few in ((1, 4_000_000, 8), (7, 4_000_000, 8), (3, 900, 3), (16, 1, 1)):
        monkeypatch.setattr(html, "PART_RUNS", most)
        monkeypatch.setattr(html, "FEW_PAGES", few)
        got = {r.page_id: r.text for r in html.extract_text(rows.repartition(parts)).collect()}
        assert got == want, (parts, most, few)  # before: the notices stayed
