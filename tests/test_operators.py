"""Operators against hand-computed values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import intervals as I
from tidemark.operators import joins as J
from tidemark.operators import matching as M
from tidemark.operators import sequences as S
from tidemark.operators import splits as P
from tidemark.operators import timelines as T

EVENTS = "scene bigint, label string, onset double, off double, event_id bigint, conf double"


def events(spark, *rows):
    return spark.createDataFrame([(1, label, float(a), float(b), i, float(c)) for i, (label, a, b, c) in enumerate(rows)], EVENTS)


def test_union_length_counts_once(spark):
    t = events(spark, ("a", 1, 2, 1), ("a", 1.5, 3, 1), ("a", 4, 4.5, 1), ("a", 9, 9, 1))
    assert I.union_length(t, ["scene"]).first().union_length == 2.5


def test_gap_merge(spark):
    t = events(spark, ("rain", 3, 5, 0.2), ("rain", 3, 5, 0.2), ("rain", 5.0625, 6, 0.7), ("wind", 3.5, 4, 0.3))
    got = sorted((r.label, r.onset, r.off, r.c) for r in I.merged(t, ["label"], 0.08, extra=[F.max("conf").alias("c")]).collect())
    assert got == [("rain", 3.0, 6.0, 0.7), ("wind", 3.5, 4.0, 0.3)]


def test_isolation_margins(spark):
    t = events(spark, ("x", 0, 0.5, 1), ("a", 1, 2, 1), ("x", 2.5, 3, 1))
    got = {r.label: (r.left_margin, r.right_margin) for r in I.isolation(t, ["scene"]).where("label = 'a'").collect()}
    assert got["a"] == (0.5, 0.5)


@pytest.mark.parametrize("bucket", [0.7, 3.0, 1000.0])
def test_overlap_join_equals_all_pairs(spark, bucket):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), float(a), float(a + rng.random() * 5)) for a in rng.random(60) * 20]
    t = spark.createDataFrame([(s, a, b, i) for i, (s, a, b) in enumerate(rows)], "scene bigint, onset double, off double, event_id bigint")
    got = sorted((r.l_event_id, r.r_event_id) for r in I.overlap_join(t, t, ["scene"], bucket).collect())
    assert got == sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(rows), repeat=2) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_set_iou_of_empty_sets_is_one(spark):
    t = events(spark, ("a", 1, 1, 1))
    assert I.set_iou(t, t, ["scene"]).first().iou == 1.0


def test_polyphony_ends_before_it_starts(spark):
    t = events(spark, ("a", 0, 1, 1), ("b", 1, 2, 1), ("c", 0.5, 1.5, 1))
    assert I.max_polyphony(t, ["scene"]).first().polyphony == 2


def test_inventory_answers(spark):
    t = events(spark, ("Kettle", 1.5, 3.25, 1), ("Bell", 4.0, 4.5, 1), ("Kettle", 6.0, 7.0, 1), ("Tram", 6.5, 9.75, 1))
    assert T.listed(t).first().answer == "Kettle, Bell, Tram"
    assert T.counted(t, "Kettle").first().n == 2 and T.counted(t, "Owl").first().present == "NO"
    assert T.located(t, "Kettle").first().answer == "1.50–3.25s, 6.00–7.00s"
    assert T.neighbours(t, "Bell", 1).first().after == "Kettle"
    assert T.between(t, "Bell", "Tram").first().labels == "Kettle"
    assert T.overlapping(t, "Tram").first().answer == "Kettle"
    x = T.extremes(t).first()
    assert (x.first, x.last, x.longest) == ("Kettle", "Tram", "Tram")
    missing = T.neighbours(t, "Owl", 1).first()
    assert (missing.before, missing.before_reason, missing.after) == ("NONE", "anchor_absent", "NONE")
    assert T.strict_neighbours(t, "Owl", 1).first().after_reason == "absent_anchor_occurrence" and T.strict_neighbours(t, "Kettle", 1).first().before_reason == "no_preceding_proposal"
    assert T.scored_neighbours(t, "Owl", 1).first().after == T.preferring_neighbours(t, "Owl", 1).first().before == "no_evidence"
    assert T.between(t, "Owl", "Bell").first().reason == "anchor_absent" and T.overlapping(t, "Bell").first().reason == "no_overlap"
    assert T.first_among(t, ["Bell", "Owl"]).first().reason == "candidate_absent"


def test_neighbours_with_ties_follow_each_dialect(spark):
    t = events(spark, ("a", 1, 2, 1), ("b", 1, 2, 1), ("a", 3, 4, 1))
    assert T.neighbours(t, "a", 1).first().after == "b"
    assert T.strict_neighbours(t, "a", 1).first().after == "a"


def test_the_best_pair_is_over_all_pairs(spark):
    t = events(spark, ("a", 0, 1, 0.5), ("b", 2, 3, 0.1), ("b", 4, 5, 0.9), ("a", 6, 7, 0.9))
    x = T.best_pair(t, "a", "b").first()
    assert (x.anchor_id, x.answer_id, x.reason) == (0, 2, "ok") and x.score == pytest.approx(1.35, abs=1e-5)
    assert T.best_pair(t, "a", "c").first().reason == "no_event_after_anchor" and T.best_pair(t, "c", "a").first().reason == "anchor_missing"
    assert T.best_pair(t, "a", "b", least=2.0).first().reason == "pair_score_below_min"


def test_open_dialects_prefer_as_stated(spark):
    t = events(spark, ("a", 0, 2, 0.9), ("b", 1, 2.5, 0.9), ("c", 2, 3, 0.4), ("d", 5, 6, 0.6), ("e", 7, 8, 0.1))
    assert T.preferring_neighbours(t, "a", 1).first().after == "d"  # apart and sure
    assert T.preferring_neighbours(t, "d", 1).first().after == "e" and T.preferring_neighbours(t, "d", 1).first().before == "c"
    assert T.scored_neighbours(t, "c", 1).first().before == "b" and T.scored_neighbours(t, "d", 1).first().after_reason == "after_missing"


def test_ranking_metrics(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.1, 0)], "score double, label int")
    r = A.ranking(s, "score", "label").first()
    assert r.auroc == pytest.approx(0.875) and r.auprc == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert A.best_balanced(s, "score", "label").first().threshold == 0.9


def test_exact_hash_split(spark):
    keys = spark.range(103).select(F.col("id").alias("k"))
    got = S.hash_split(keys, "k", 0.2, "s")
    assert got.where("chosen").count() == 20 and got.count() == 103


def test_matching_rules_differ():
    predicted = [(0.0, 10.0, 0.5), (4.0, 14.0, 0.9)]
    gold = [(5.0, 15.0), (20.0, 30.0)]
    assert M.match_greatest(predicted, gold, 0.3) in ([(0, 0)], [(1, 0)])
    assert M.match_by_onset(predicted, gold, 0.3) == [(0, 0)]
    assert M.match_by_confidence(predicted, gold, 0.3) == [(1, 0)] == M.match_pairs(predicted, gold, 0.3)
    chain = [(0.0, 2.0, 0.9), (1.0, 3.0, 0.8)]
    assert len(M.match_greatest(chain, [(0.9, 2.9), (2.0, 4.0)], 0.2)) == 2


def test_assignment_is_cheapest():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6)):
        cost = rng.random((n, m))
        got = M.assignment(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best) and len(set(got)) == n


def test_small_sequences():
    assert M.suppressed([(0, 10, 0.9), (1, 11, 0.8), (20, 30, 0.7)], 0.5) == [0, 2]
    assert M.split_at_peaks(0, 10, [2, 6]) == [(0, 4), (4, 10)]
    assert M.unique_starts([3, 3, 3], [1, 1, 1], 5) == [3, 4, 2]
    assert M.boundary_error([1.0, 5.0], [1.5]) == pytest.approx(5.25)
    assert M.word_distance("a b c".split(), "a x c d".split()) == 2
    assert M.vote([["a", "b"], ["a", "c"], ["a", "c", "d"]]) == ["a", "c"] and M.vote([]) == []
    assert M.vote([["p", "q"], ["p", "r"]]) == ["p", "r"]  # of equal counts the greater word
    assert M.vote([["x"], ["k", "m", "n"], ["k", "m", "n"]]) == ["k", "m", "n"]  # the middle one gives the slots
    assert M.vote([["k"], ["k", "z"]]) == ["k", "z"]  # a word beats no word of equal count
    assert X.parse_question("What came after the second owl call?", ["owl call"]) == ("after", ["owl call"], 2)
    assert X.exact_question("  Straße\u00a0Ⅳ \n x ") == "strasse iv x"
    assert X.normalize("Çafé_Noir & Đ") == "cafe noir and"


def test_long_chains_of_matches_need_no_recursion():
    n = 3000
    assert sum(p >= 0 for p in M.maximum_matching([[i, i + 1] if i else [0, 1] for i in range(n)][::-1], n + 1)) == n
    rng = np.random.default_rng(3)
    for _ in range(60):
        adjacent = [[j for j in range(5) if rng.random() < 0.4] for _ in range(5)]
        best = max(sum(j >= 0 and j in adjacent[i] for i, j in enumerate(p)) for p in itertools.permutations(range(5)))
        assert sum(p >= 0 for p in M.maximum_matching(adjacent, 5)) == best
    # each prediction to its best overlap: the wide one leaves the narrow gold to the other
    assert M.match_greatest([(0.0, 10.0, 0.9), (0.0, 4.0, 0.5)], [(0.0, 5.0), (0.0, 9.0)], 0.3) == [(0, 1), (1, 0)]


def test_conditions_and_reports(spark):
    from tidemark.operators import audits as D
    from tidemark.sources import writers

    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, float("inf")), (5, 9.0)], "k bigint, v double")
    got = {(r.k, r.gate) for r in D.failed_conditions(df, "k", {"a": [("v", "v", ">=", 6.0)], "b": [("v", "v", "<=", 6.0)]}).collect()}
    assert got == {(1, "a"), (5, "b"), *((k, g) for k in (2, 3, 4) for g in "ab")}
    with pytest.raises(ValueError):
        writers.markdown(df, 4)
    assert len(writers.markdown(df).split("\n")) == 7
    with pytest.raises(ValueError):
        A.grid_fit(df, "v", "k", "test")


def test_selection_rules():
    groups = {f"g{i}": P.Counter({"a": 1 + i % 3, "b": i % 2}) for i in range(20)}
    dev = P.improved_partition(groups, P.stratified_dev(groups, 0.25, "s"), 0.25)
    total = sum((groups[g] for g in dev), P.Counter())
    every = sum(groups.values(), P.Counter())
    assert abs(total["a"] / every["a"] - 0.25) < 0.1 and abs(total["b"] / every["b"] - 0.25) < 0.15
    assert P.packed_groups([("a", 5), ("b", 6), ("c", 1)], 2, 10) == [["a"], ["b", "c"]]
    got = P.isolated_allocation([("s1", "a", "o"), ("s2", "b", "o"), ("s3", "b", "p")], {"a": 1, "b": 1}, "s")
    assert got == {"a": ["s1"], "b": ["s3"]}


def test_closure_rejects_cycles(spark):
    with pytest.raises(ValueError):
        J.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string"))


def test_components_over_shared_identities(spark):
    rows = [(1, "x", None), (2, "x", "u"), (3, "y", "u"), (4, "z", None), (5, None, None)]
    got = {r.k: r.component for r in P.components(spark.createDataFrame(rows, "k bigint, a string, b string"), "k", ["a", "b"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
