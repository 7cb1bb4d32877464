"""Decoders, segments, thresholds, votes and quotes against their definitions."""

import difflib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import decoding as D
from tidemark.operators import matching as M


def series(seed, n):
    rng = np.random.default_rng(seed)
    return np.round(np.clip(rng.random(n) + 0.3 * np.sin(np.arange(n) / 2), 0, 1), 1)


def frames(spark, waves):
    return spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(waves) for i, v in enumerate(x)], "scene int, frame bigint, p double")


def by_scene(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.scene, []).append((r.start, r.stop, round(r.peak, 6)))
    return {k: sorted(v) for k, v in out.items()}


def neighbours(x, a, b):
    """Frames of x[a:b] not below what stands beside them there."""
    return [i for i in range(a, b) if all(x[i] >= x[j] for j in (i - 1, i + 1) if a <= j < b)]


def apart(x, at, gap):
    """The set kept by: an element stays if no higher (or equal and earlier) kept one is near."""
    kept = set()
    for i in sorted(at, key=lambda i: (-x[i], i)):
        if not any(abs(i - k) < gap for k in kept):
            kept.add(i)
    return sorted(kept)


def runs(x, least):
    on = [i for i, v in enumerate(x) if v >= least]
    return [(i, next(j for j in itertools.count(i) if j not in on)) for i in on if i - 1 not in on]


def defined(x, kind, high, low, gap, ratio, merge):
    """The events by their definition: for each frame, whose piece it belongs to."""
    seeds = []
    for a, b in runs(x, high):
        cuts = {a, b}
        if kind == "valley":
            tops = apart(x, [i for i in neighbours(x, a, b) if x[i] >= 0.7 * max(x[a:b])], gap)
            for i, j in zip(tops, tops[1:]):
                v = min(range(i, j + 1), key=lambda k: (x[k], k))
                if j - i > 1 and x[v] <= ratio * min(x[i], x[j]):
                    cuts.add(min(max(v, a + 1), b - 1))
        seeds += itertools.pairwise(sorted(cuts))
    if kind == "threshold":
        pieces = [(a, b) for a, b in seeds]
    else:
        tops = apart(x, [i for i in neighbours(x, 0, len(x)) if x[i] >= high], gap) if kind == "peak" else [max(range(a, b), key=lambda i: (x[i], -i)) for a, b in seeds]
        pieces = []
        for n, t in enumerate(tops):
            first = (tops[n - 1] + t) // 2 if n else 0
            last = max(first + 1, (t + tops[n + 1]) // 2) if n + 1 < len(tops) else len(x)
            own = [i for i in range(len(x)) if (i == t or first <= i < last) and all(x[k] >= low for k in range(min(i, t), max(i, t) + 1))]
            pieces.append((own[0], own[-1] + 1))
    out = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1] + merge:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2].append((a, b))
        else:
            out.append([a, b, [(a, b)]])
    return sorted((a, b, round(float(max(max(x[c:d]) for c, d in parts)), 6)) for a, b, parts in out)


@pytest.mark.parametrize(("kind", "gap", "merge"), [("threshold", 1, 0), ("threshold", 1, 2), ("hysteresis", 1, 0), ("valley", 1, 0), ("valley", 3, 1), ("peak", 1, 0), ("peak", 4, 0)])
def test_decoded_events_are_as_defined(spark, kind, gap, merge):
    waves = [series(s, n) for s, n in enumerate([1, 2, 5, 30, 60, 60, 80, 40])] + [np.zeros(6), np.ones(6)]
    got = by_scene(D.decoded(frames(spark, waves), ["scene"], 0.6, 0.3, kind, gap, 0.7, merge))
    assert got == {k: v for k, x in enumerate(waves) if (v := defined(x, kind, 0.6, 0.3, gap, 0.7, merge))}


def test_valleys_cut_a_run(spark):
    x = np.array([0.8, 0.6, 0.5, 0.6, 0.9])
    parts = lambda ratio: sorted({(r.start, r.stop) for r in D.valley_parts(D.islands(frames(spark, [x]), ["scene"], 0.5), ["scene"], 1, ratio).collect()})
    assert parts(0.7) == [(0, 2), (2, 5)] and parts(0.1) == [(0, 5)]


def test_strongest_segments_are_as_defined(spark):
    waves = [series(s + 50, n) for s, n in enumerate([1, 7, 30, 60])] + [np.zeros(4), np.array([0.1, 0.3, 0.9, 0.3, 0.6, 0.3, 0.1, 0.7, 0.1])]
    want = {}
    for k, x in enumerate(waves):
        pool, found = {i: v for i, v in enumerate(x)}, []
        for _ in range(9):
            if len(found) == 3 or not pool or max(pool.values()) < 0.2:
                break
            top = max(pool, key=lambda i: (pool[i], -i))
            cut = max(0.2, 0.6 * pool[top])
            a = next(i for i in itertools.count(top, -1) if pool.get(i - 1, -1) < cut)
            b = next(i for i in itertools.count(top + 1) if pool.get(i, -1) < cut)
            if all(M.iou((a, b), s[:2]) < 0.5 for s in found):
                found.append((a, b, round(float(pool[top]), 6)))
            for i in range(a, b):
                pool.pop(i)
        if found:
            want[k] = sorted(found)
    assert by_scene(D.strongest(frames(spark, waves), ["scene"], 3, 0.6, 0.2)) == want


def test_class_thresholds_equal_a_search_over_the_grid(spark):
    rng, grid = np.random.default_rng(3), [0.3, 0.5, 0.7]
    rows, gold = [], []
    for scene in range(4):
        for label in "abc":
            x = series(scene * 3 + ord(label), 40)
            rows += [(scene, label, i, float(v)) for i, v in enumerate(x)]
            if label != "c":
                gold += [(scene, label, float(a), float(a + rng.integers(1, 8))) for a in rng.integers(0, 35, 3)]
    chosen, curves = D.class_thresholds(spark.createDataFrame(rows, "scene int, label string, frame bigint, p double"), spark.createDataFrame(gold, "scene int, label string, onset double, off double"), grid, 0.3, 2, 1)

    def most(p, g):
        """The size of a largest matching, by trying sets."""
        sets = {frozenset()}
        for e in p:
            sets |= {s | {j} for s in sets for j, o in enumerate(g) if j not in s and M.iou(e, o) >= 0.3}
        return max(map(len, sets))

    want = {}
    for label in "abc":
        for t in grid:
            tp = fp = fn = 0
            for scene in range(4):
                x = [r[3] for r in rows if r[:2] == (scene, label)]
                events = [(a, b) for a, b, _ in defined(x, "threshold", t, t, 1, 1, 1) if b - a >= 2]
                g = [o[2:] for o in gold if o[:2] == (scene, label)]
                n = most(events, g)
                tp, fp, fn = tp + n, fp + len(events) - n, fn + len(g) - n
            p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
            want[label, t] = (tp, fp, fn, round(2 * p * r / max(p + r, 1e-12), 9), p, r)
    got = {(r.label, r.threshold): (r.tp, r.fp, r.fn, round(r.f1, 9), r.precision, r.recall) for r in curves.collect()}
    assert got == want
    best = {label: max(grid, key=lambda t: (*want[label, t][3:], -want[label, t][1], t)) for label in "abc"}
    assert {r.label: r.threshold for r in chosen.collect()} == best


def test_votes():
    assert M.vote([[], [], ["a"]]) == [] and M.vote([[], ["a"], ["a"]]) == ["a"] and M.vote([[], []]) == []
    table = M.widened([("a",), ("b",)], ["a", "x", "b"])
    assert table == [("a", "a"), ("", "x"), ("b", "b")] and M.leaders(table) == ["a", "x", "b"]


def brute_quote(quote, said):
    target, words = X.normalize(quote) or "", [X.normalize(w) or "" for w in said or []]
    if not target or not words:
        return None
    n = len(target.split())
    windows = [(a, b) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if n - 2 <= b - a <= n + 2]
    if not windows:
        return None
    scored = [(difflib.SequenceMatcher(None, target, " ".join(words[a:b])).ratio(), -a, -b) for a, b in windows]
    r, a, b = max(scored)
    return round(r, 9), -a, -b


def test_quotes_are_the_most_alike_windows(spark):
    rows = [("hello big world", "oh hello big world bye"), ("green tea", "tee green teas green tea"), ("", "a"), ("x", ""), (None, "a b"), ("a b", None), ("a b c d e f g", "a"), ("Çafé noir", "Un CAFE (noir) s'il vous plaît"), ("one two", "one two")]
    rows += [(" ".join(p), "the cat sat on the mat and the bat sat too") for p in itertools.permutations(["cat", "sat", "the"])]
    df = spark.createDataFrame([(i, q, s.split() if s is not None else None) for i, (q, s) in enumerate(rows)], "i int, quote string, said array<string>")
    out = X.with_quotes(df, "quote", "said").select("*", X.beside_quote("said", "found", True).alias("before"), X.beside_quote("said", "found", False).alias("after"))
    for r in out.collect():
        found = brute_quote(r.quote, r.said)
        assert (found is None and r.found is None) or (round(r.found.ratio, 9), r.found.start, r.found.stop) == found
        assert r.before == (" ".join(r.said[: found[1]]) if found else "") or r.before == "NONE"
        assert r.after == (" ".join(r.said[found[2] :]) if found else "") or r.after == "NONE"
    assert out.where("i = 0").first().after == "bye" and out.where("i = 8").first().before == "NONE"


def test_fuzzy_mentions_by_place(spark):
    asked = ["a whistel then a whistle and a kettel", "an espreso machine hissed", "", None, "kettle whistle", "nothing here"]
    df = spark.createDataFrame([(t,) for t in asked], "t string")
    variants = {"whistle": "W", "kettle": "K", "pan": "P", "espresso machine": "E", "kettles": "K"}
    got = [r.labels for r in X.with_fuzzy_mentions(df, "t", variants).collect()]
    assert got == [["W"], ["E"], [], [], ["K", "W"], []]
    assert X.with_fuzzy_mentions(df, "t", {"pan": "P"}).select(F.max(F.size("labels"))).first()[0] == 0
