"""Boundaries, slots, speakers, selections, fetchers, resumed reads and quotas against their definitions."""

import io
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detection as D
from tidemark.operators import selection as S
from tidemark.operators import speakers as V
from tidemark.operators import splits as P
from tidemark.plans import REGISTRY
from tidemark.sources import fetched, groups
from tidemark.streaming import quotas

SF = "/root/testdata/sf0.001"


def largest(p, g, fits):
    sets = {frozenset()}
    for x in p:
        sets |= {s | {j} for s in sets for j, y in enumerate(g) if j not in s and fits(x, y)}
    return max(map(len, sets))


def test_boundaries_are_paired_as_often_as_can_be(spark):
    rng = np.random.default_rng(1)
    for _ in range(200):
        p, g = (np.sort(rng.integers(0, 30, rng.integers(0, 9))).astype(float) for _ in range(2))
        assert D.paired(p, g, 2.0) == largest(p, g, lambda x, y: abs(x - y) <= 2)
    rows = [(int(s), "ab"[int(x)], float(t)) for s, x, t in zip(rng.integers(0, 3, 80), rng.integers(0, 2, 80), rng.integers(0, 60, 80))]
    sides = rows[::2], [*rows[1::2], (9, "c", 1.0)]
    df = [spark.createDataFrame(x, "scene int, label string, onset double") for x in sides]
    got = {r.label: (r.tp, r.fp, r.fn) for r in D.boundary_counts(*df, ["scene", "label"], "onset", 2.0).collect()}
    want = {}
    for scene, label in {r[:2] for r in [*sides[0], *sides[1]]}:
        p, g = ([r[2] for r in x if r[:2] == (scene, label)] for x in sides)
        n = largest(p, g, lambda x, y: abs(x - y) <= 2)
        old = want.get(label, (0, 0, 0))
        want[label] = old[0] + n, old[1] + len(p) - n, old[2] + len(g) - n
    assert got == want
    r = D.f1_rows(D.boundary_counts(*df, ["scene", "label"], "onset", 2.0)).first()
    f1 = lambda t: 2 * t[0] / max(1, 2 * t[0] + t[1] + t[2])
    assert r.micro_f1 == pytest.approx(f1([sum(x) for x in zip(*want.values())])) and r.macro_f1 == pytest.approx(np.mean([f1(t) for t in want.values() if t[0] + t[2]]))


def test_slots_are_assigned_at_least_cost(spark):
    rng = np.random.default_rng(2)
    slots, gold = [], []
    for scene, (n, m) in enumerate([(3, 3), (2, 5), (5, 2), (1, 0), (0, 2), (4, 4)]):
        for rows, count in ((slots, n), (gold, m)):
            for i in range(count):
                a = rng.random()
                rows.append((scene, i, a, a + rng.random() / 4, rng.random()))
    got = {}
    for r in D.assigned_slots(spark.createDataFrame(slots, "scene int, slot bigint, onset double, off double, conf double"), spark.createDataFrame(gold, "scene int, gold bigint, onset double, off double, conf double"), ["scene"]).collect():
        got.setdefault(r.scene, []).append(r)

    def cost(s, g):
        inner, hull = min(s[3], g[3]) - max(s[2], g[2]), max(s[3], g[3]) - min(s[2], g[2])
        return 5 * (abs(s[2] - g[2]) + abs(s[3] - g[3])) + 2 * (1 - max(0, inner) / hull) - s[4]

    for scene in range(6):
        p, g = ([r for r in x if r[0] == scene] for x in (slots, gold))
        small, large = (p, g) if len(p) <= len(g) else (g, p)
        best = min(sum(cost(*((a, b) if small is p else (b, a))) for a, b in zip(small, some)) for some in itertools.permutations(large, len(small)))
        pairs = [r for r in got[scene] if r.cost is not None]
        assert sum(r.cost for r in pairs) == pytest.approx(best) and len(pairs) == len(small)
        assert sorted(r.slot for r in got[scene] if r.slot is not None) == list(range(len(p))) and sorted(r.gold for r in got[scene] if r.gold is not None) == list(range(len(g)))


def test_the_assignment_query_is_cheapest_in_each_week(spark):
    weeks = {}
    for r in REGISTRY["slot_assignment"].run(spark, SF).collect():
        weeks.setdefault((r.scene, r.week), []).append(r)
    assert all(sum(r.cost is not None for r in rows) == min(sum(r.slot is not None for r in rows), sum(r.gold is not None for r in rows)) for rows in weeks.values())
    assert sum(r.slot is not None for rows in weeks.values() for r in rows) + sum(r.gold is not None for rows in weeks.values() for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def plain_linkage(x, count):
    """Average linkage by its definition: means over all pairs of rows, clusters as lists."""
    unit = [v / np.linalg.norm(v) for v in x]
    far = [[0.0 if i == j else float(np.clip(1 - a @ b, 0, 2)) for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    sets = [[i] for i in range(len(x))]
    while len(sets) > count:
        mean = lambda a, b: np.mean([far[i][j] for i in a for j in b])
        a, b = min(itertools.combinations(range(len(sets)), 2), key=lambda p: round(mean(sets[p[0]], sets[p[1]]), 12))
        sets[a] += sets.pop(b)
    return sorted(map(sorted, sets)), far


def plain_silhouette(sets, far):
    out = []
    for s in sets:
        for i in s:
            a = sum(far[i][j] for j in s) / max(1, len(s) - 1)
            b = min(np.mean([far[i][j] for j in o]) for o in sets if o is not s)
            out.append((b - a) / max(a, b) if len(s) > 1 else 0.0)
    return np.mean(out)


def test_speakers_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    for n, k in [(12, 3), (9, 2), (20, 4), (6, 1)]:
        centres = rng.normal(size=(k, 5))
        x = centres[np.arange(n) % k] + rng.normal(size=(n, 5)) * 0.35
        scores = {}
        for count in range(2, min(5, n // 2) + 1):
            sets, far = plain_linkage(x, count)
            if min(map(len, sets)) >= 2:
                scores[count] = plain_silhouette(sets, far), sets
        best = max((s for s, _ in scores.values()), default=None)
        want = [sorted(range(n))]
        if best is not None and best >= 0.25:
            want = scores[min(c for c, (s, _) in scores.items() if s >= best - 0.02)][1]
        found, score = V.speakers(x, 5, 2)
        assert sorted([i for i in range(n) if found[i] == c] for c in range(found.max() + 1)) == want
        assert score == (None if best is None else pytest.approx(best))
    assert V.speakers(np.ones((1, 3)), 4, 2)[1] is None and V.speakers(np.zeros((0, 3)), 4, 2)[0].size == 0


def test_the_speaker_query_equals_plain_loops(spark):
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = REGISTRY["speaker_windows"].run(spark, SF).collect()
    assert {r.window for r in rows} == set(e)
    for recording in sorted({r.recording for r in rows})[:3]:
        own = sorted((r for r in rows if r.recording == recording), key=lambda r: r.window)
        x = [e[r.window] for r in own]
        scores = {}
        for count in range(2, min(6, len(x) // 2) + 1):
            sets, far = plain_linkage(x, count)
            if min(map(len, sets)) >= 2:
                scores[count] = plain_silhouette(sets, far), sets
        best = max((s for s, _ in scores.values()), default=None)
        count = min(c for c, (s, _) in scores.items() if s >= best - 0.02) if best is not None and best >= 0.25 else 1
        assert {r.speakers for r in own} == {count} and own[0].silhouette == (None if best is None else pytest.approx(best))


def candidates(rng, n, routes):
    return [(i, f"r{rng.integers(routes)}", int(rng.choice([1, 2])) + int(rng.choice([0, 0, 4, 8])), [f"k{x}" for x in rng.integers(0, 6, rng.integers(1, 3))], [int(rng.integers(0, 3))]) for i in range(n)]


CANDIDATE = "row bigint, route string, mask bigint, labels array<string>, tiers array<int>"


@pytest.mark.parametrize("seed", range(4))
def test_stratified_selections_equal_all_selections(spark, seed):
    rows = candidates(np.random.default_rng(seed), 11, 3)
    got = S.stratified(spark.createDataFrame(rows, CANDIDATE), 2, [3, 12])
    of = {r[0]: r for r in rows}
    per = [[r[0] for r in rows if r[1] == route] for route in sorted({r[1] for r in rows})]

    def quality(some):
        mask = 0
        for i in some:
            mask |= of[i][2]
        return (mask & 3).bit_count(), (mask & 12).bit_count(), len({x for i in some for x in of[i][3]}), len({x for i in some for x in of[i][4]})

    every = (sum(x, ()) for x in itertools.product(*[itertools.combinations(p, min(2, len(p))) for p in per]))
    assert quality(got.row) == max(map(quality, every))
    assert sorted(got.route) == sorted(of[i][1] for i in got.row) and all(label in of[i][3] for i, label in zip(got.row, got.label))
    choices = itertools.product(*[set(of[i][3]) for i in got.row])
    assert (len(set(got.label)) == len(got)) == any(len(set(c)) == len(c) for c in choices)


def test_the_selection_query_covers_every_route(spark):
    got = REGISTRY["stratified_routes"].run(spark, SF).collect()
    rows = {r.row: r for r in __import__("tidemark.plans.detection_queries", fromlist=["routed"]).routed(spark, SF).collect()}
    assert len(got) == 2 * len({r.route for r in rows.values()}) and len({r.label for r in got}) == min(len(got), 9)
    bits = 0
    for r in got:
        bits |= rows[r.row].mask
    assert bits == 15


def test_balanced_groups_share_more_than_a_cut(spark):
    rng = np.random.default_rng(6)
    for n, k in [(10, 3), (12, 4), (9, 2), (5, 5)]:
        truth = np.arange(n) % k
        confusion = np.where(truth[:, None] == truth[None], 1.0, 0.15) * rng.random((n, n))
        affinity = S.affinities(confusion, rng.normal(size=(n, 8)))
        group = S.balanced_groups(affinity, k)
        sizes = np.bincount(group, minlength=k)
        assert sizes.max() - sizes.min() <= 1 and len(sizes) == k
        line = np.argsort(S.spectral(affinity, 2)[:, 0], kind="stable")
        cut = np.empty(n, int)
        cut[line] = np.arange(n) * k // n
        assert S.within_share(affinity, group) >= S.within_share(affinity, cut) - 1e-12
    with pytest.raises(ValueError, match="more groups"):
        S.balanced_groups(np.eye(2), 3)
    sizes = {}
    for r in REGISTRY["balanced_partition"].run(spark, SF).collect():
        sizes[r.grp] = sizes.get(r.grp, 0) + 1
    assert sorted(sizes.values()) == [3, 3, 4]


def parquet_bytes(n, rows):
    out = io.BytesIO()
    pq.write_table(pa.table({"i": list(range(n)), "s": [f"x{i}" for i in range(n)], "v": [i / 2 for i in range(n)]}), out, row_group_size=rows)
    return out.getvalue()


def test_fetchers_are_injected_tried_again_and_pruned(spark, tmp_path):
    content, log = parquet_bytes(100, 10), str(tmp_path / "log")

    def flaky(path):
        with open(log, "a") as f:
            f.write("x")
        with open(log) as f:
            if len(f.read()) % 3 == 1:  # the first, fourth, ... fetch fails
                raise OSError("gone")
        return io.BytesIO(content)

    def load(**options):
        r = spark.read.format(fetched.registered(spark, flaky, "flaky")).option("paths", "mem://a\nmem://b").option("wait", "0.01")
        for k, v in options.items():
            r = r.option(k, v)
        return r.load()

    rows = load(attempts="6")
    assert rows.columns == ["i", "s", "v"] and rows.count() == 200 and rows.agg(F.sum("i")).first()[0] == 9900
    few = load(attempts="6", columns="v,i").where("i >= 35 AND i < 41")
    assert sorted(tuple(r) for r in few.collect()) == sorted([(i / 2, i) for i in range(35, 41)] * 2)
    reader = fetched.Reader(["mem://a"], ["i"], lambda path: io.BytesIO(content), 1, 0)
    kept = list(reader.pushFilters([fetched.GreaterThanOrEqual(("i",), 35), fetched.LessThan(("i",), 41), fetched.EqualTo(("s",), "x38")]))
    assert len(kept) == 3 and [g.number for g in reader.partitions()] == [3]
    with pytest.raises(Exception, match="gone"):
        fetched.Reader(["mem://a"], ["i"], lambda path: (_ for _ in ()).throw(OSError("gone")), 2, 0.01).partitions()


def test_reads_of_groups_resume_and_stop(spark, tmp_path):
    paths = []
    for name in "ab":
        (tmp_path / name).write_bytes(parquet_bytes(50, 10))
        paths.append(f"file://{tmp_path}/{name}")
    state, calls, opened = f"file://{tmp_path}/state", str(tmp_path / "calls"), str(tmp_path / "opened")

    def note(at, x):
        with open(at, "a") as f:
            f.write(json.dumps(x) + "\n")

    def noted(at):
        with open(at) as f:
            return [tuple(json.loads(x)) for x in f]

    def fetch(path):
        note(opened, [path])
        return fetched.open_uri(path)

    def breaking(path, number, table):
        if path.endswith("a") and number == 2:
            raise RuntimeError("broken")
        note(calls, [path[-1], number])
        return table

    with pytest.raises(Exception, match="broken"):
        groups.process_groups(spark, paths, ["i"], breaking, state, fetch).collect()

    def stopping(path, number, table):
        note(calls, [path[-1], number])
        return None if path.endswith("a") and number == 3 else table

    groups.process_groups(spark, paths, ["i"], stopping, state, fetch).collect()
    assert sorted(noted(calls)) == [("a", n) for n in range(4)] + [("b", n) for n in range(5)]  # none twice, none after the stop
    assert groups.process_groups(spark, paths, ["i"], stopping, state, fetch).count() == 0
    kept = sorted(r.i for r in groups.kept_rows(spark, state, "i bigint").collect())
    assert kept == sorted([*range(30), *range(50)])

    def failing_once():
        failed = []

        class Once(io.FileIO):
            def read(self, *a):
                if not failed and self.tell() < 400:
                    failed.append(1)
                    raise OSError("line is down")
                return super().read(*a)

        return lambda path: Once(path.removeprefix("file://"))

    other = f"file://{tmp_path}/other"
    seen = groups.process_groups(spark, paths[:1], ["i"], lambda path, number, table: table, other, failing_once(), wait=0.01).collect()
    assert [(r.row_group, r.n_rows) for r in seen] == [(n, 10) for n in range(5)]
    assert sorted(r.i for r in groups.kept_rows(spark, other, "i bigint").collect()) == list(range(50))


@pytest.mark.parametrize("most", [None, 7])
def test_quotas_equal_the_ordered_fold(spark, most):
    rng = np.random.default_rng(8)
    rows = [(i, [f"k{x}" for x in sorted(set(rng.integers(0, 5, rng.integers(0, 4)).tolist()))]) for i in range(60)]
    wanted, counts, kept = ["k0", "k1", "k2", "k9"], {}, []
    for i, labels in rows:  # the rule, row by row
        helped = [x for x in labels if x in wanted and counts.get(x, 0) < 4]
        if helped and (most is None or len(kept) < most):
            kept.append(i)
            for x in helped:
                counts[x] = counts.get(x, 0) + 1
    q = quotas.QuotaStream(spark, "i", "labels", "i", wanted, 4, most)
    out = q.run(quotas.ordered_stream(spark, spark.createDataFrame(rows, "i bigint, labels array<string>"), "i", 5))
    assert sorted(r.i for r in out.collect()) == kept
    manifests = q.manifests()
    assert [m.batch for m in manifests] == list(range(5)) and manifests[-1].counts == counts and manifests[-1].kept == len(kept)
    assert manifests[-1].finished == (most is not None) and (most is not None or manifests[-1].seen == 60)
    again = spark.createDataFrame(rows, "i bigint, labels array<string>").where("i < 12")
    q.step(again, 0)  # a batch that is tried again leaves the same
    assert q.manifests()[0] == manifests[0]


def test_quotas_that_are_met_stop_early(spark):
    q = quotas.QuotaStream(spark, "i", "labels", "i", ["a"], 3)
    out = q.run(quotas.ordered_stream(spark, spark.range(20).select(F.col("id").alias("i"), F.array(F.lit("a")).alias("labels")), "i", 4))
    assert sorted(r.i for r in out.collect()) == [0, 1, 2] and [m.finished for m in q.manifests()] == [True] * 4 and q.manifests()[-1].seen == 5


def test_families_are_picked_in_turns(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 14)), "abc"[rng.integers(3)], int(rng.integers(0, 50)), i) for i in range(90)]
    df = spark.createDataFrame(rows, "family int, category string, score int, id int")
    quota = {"b": 3, "a": 4, "c": 2}
    got = P.diverse_families(df, "family", "category", [F.desc("score"), F.col("id")], quota)
    queues = {}
    for c in quota:
        best = {}
        for f, _, s, i in sorted((r for r in rows if r[1] == c), key=lambda r: (-r[2], r[3])):
            best.setdefault(f, (-s, i, f))
        queues[c] = sorted(best.values())
    want, used = [], set()
    for turn in range(max(quota.values())):
        for c in (c for c, n in quota.items() if n > turn):
            f = next(f for *_, f in queues[c] if f not in used)
            used.add(f)
            want.append((c, f))
    assert got == want
    with pytest.raises(ValueError, match="too few"):
        P.diverse_families(df.where("family < 3"), "family", "category", [F.desc("score")], quota)
    picked = REGISTRY["diverse_families"].run(spark, SF).collect()
    assert len({r.family for r in picked}) == len(picked) == 12


def test_builds_are_locked(spark):
    row = "id int, grp int, labels array<string>"
    train = spark.createDataFrame([(i, i // 2, ["a"] if i % 3 else ["b", "x"]) for i in range(20)] + [(90, 50, ["x"])], row)
    test = spark.createDataFrame([(100 + i, 100 + i, ["a"]) for i in range(3)], row)
    kept = spark.createDataFrame([(200, 200, ["b"], "dev"), (201, 201, ["a"], "test"), (202, 202, ["x"], "train")], row + ", split string")
    build = lambda a=train, b=test, c=kept, o=("a", "b"): P.locked_build(a, b, c, "grp", "labels", ["id", "grp"], list(o), 0.3, "s")
    out = {r.id: r for r in build().collect()}
    assert set(out) == {*range(20), 100, 101, 102, 200, 201}
    assert all(out[i].split == "test" and out[i].origin == "official" for i in (100, 101, 102)) and (out[200].split, out[201].split) == ("dev", "test")
    assert all(out[i].split == out[i + 1].split for i in range(0, 20, 2)) and {out[i].split for i in range(20)} == {"train", "dev"}
    assert all(set(r.labels) <= {"a", "b"} for r in out.values())
    for message, bad in [("share a group", lambda: build(b=test.union(train.limit(1)))), ("known split", lambda: build(c=kept.withColumn("split", F.lit("validation")))), ("two splits", lambda: build(c=kept.withColumn("id", F.lit(100)).withColumn("split", F.lit("dev")))), ("without a train row", lambda: build(o=("a", "b", "q")))]:
        with pytest.raises(ValueError, match=message):
            bad()


def test_the_build_query_keeps_its_sides(spark):
    for r in REGISTRY["locked_build"].run(spark, SF).collect():
        assert (r.grp % 5 == 3) == (r.origin == "official" and r.split == "test") and (r.grp % 5 == 4) == (r.origin == "preserved")
        assert r.origin != "preserved" or r.split == ("train", "dev", "test")[r.grp % 3]


def test_covers_equal_the_ordered_fold(spark):
    import hashlib

    rng = np.random.default_rng(7)
    rows = [(i, "abcd"[x]) for i in range(40) for x in set(rng.integers(0, 4, 3).tolist())]
    quota, have, want = {"a": 3, "b": 5, "c": 0}, {}, []
    for i in sorted(range(40), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest()):
        needed = [x for k, x in rows if k == i and have.get(x, 0) < quota.get(x, 0)]
        if needed:
            want.append(i)
        for x in needed:
            have[x] = have.get(x, 0) + 1
    got = P.cover(spark.createDataFrame(rows + rows[:9], "i int, x string"), "i", "x", quota, "s").orderBy("place").collect()
    assert [r.i for r in got] == want


def test_streams_tell_of_every_batch(spark, tmp_path):
    from tidemark.streaming import streams

    for i in range(130):
        pq.write_table(pa.table({"event_id": [i], "ts": pa.array([1_600_000_000_000_000 + i], pa.timestamp("us"))}), f"{tmp_path}/{i:04d}.parquet")
    seen = []
    rows = streams.drained(streams.event_stream(spark, str(tmp_path), 1), notify=lambda name, payload: seen.append((name, payload)))
    assert rows.count() == 130 and seen[-1] == ("finished", {"batches": 130}) and sum(p["rows"] for n, p in seen if n == "batch") == 130
    assert [p["number"] for n, p in seen if n == "batch"] == list(range(130))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, *d: {"spark.sql.warehouse.dir": "file:/tmp/w"}.get(k, *d)), _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(cluster)
    monkeypatch.setattr(session, "machine_local", lambda *a: False)
    assert session.shared_dir(cluster) == "file:/tmp/w"


def test_plans_are_locked_and_quotas_exact(spark):
    rows = [(1, "train", "a", "x", 1), (1, "train", "b", "x", 2), (2, "eval", "a", "y", 3)]
    df = lambda x: spark.createDataFrame(x, "video int, split string, label string, location string, request int")
    quota = {("train", "a"): 1, ("train", "b"): 1, ("eval", "a"): 1}
    got = {r.video: [tuple(x) for x in r.requests] for r in P.locked_plan(df(rows), quota).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [("a", 3)]}
    for message, bad, q in [("not one split", [*rows, (1, "eval", "a", "x", 4)], quota), ("not one location", [*rows, (2, "eval", "a", "z", 4)], quota), ("2 requests instead of 1", [*rows, (3, "eval", "a", "y", 4)], quota), ("0 requests instead of 2", rows, quota | {("eval", "c"): 2}), ("instead of 0", rows, {k: v for k, v in quota.items() if k[0] == "train"})]:
        with pytest.raises(ValueError, match=message):
            P.locked_plan(df(bad), q)


def test_reserves_are_used_in_order(spark):
    rows = [("a", 1, True, True), ("a", 2, True, False), ("a", 3, False, False), ("b", 1, True, True), ("b", 2, False, False), ("b", 3, True, True), ("c", 1, True, True), ("d", 1, False, False)]
    got = {r.k: (r.accepted, r.in_order, r.request) for r in P.topup(spark.createDataFrame(rows, "k string, n int, done boolean, ok boolean"), ["k"], [F.col("n")], "done", "ok", 3, 1.5).collect()}
    assert got == {"a": (1, True, 1), "b": (2, False, 0), "c": (1, True, 0), "d": (0, True, 1)}


def test_evidence_metrics_keep_ties_in_any_order(spark):
    intervals = lambda x: spark.createDataFrame(x, "k bigint, onset double, off double")
    records = lambda x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "k bigint, no_evidence boolean, p double")
    none = intervals([])
    ties = {(0.0, 0.365): 0.066613, (0.002, 0.027): 0.000367, (0.006, 0.297): 0.044123}  # (p1 ** 2 + p2 ** 2) / 2 ends in 5 at the seventh place
    for p, want in ties.items():
        assert D.evidence_metrics(none, none, records([(False, x) for x in p]), "k").select(F.round("brier", 6)).first()[0] == want
    rng, seen = np.random.default_rng(2), set()
    shares = [(k, k / 37, 1 + k / 11) for k in range(40)]  # gold [0, 1 + k / 11], predicted from k / 37 on
    for order in (rng.permutation(40) for _ in range(6)):
        place = {int(k): i for i, k in enumerate(order)}
        gold, late = intervals([(place[k], 0.0, b) for k, _, b in shares]), intervals([(place[k], a, b) for k, a, b in shares])
        seen.add(tuple(D.evidence_metrics(late, gold, records([(int(k) >= 30, int(k) / 40) for k in order]), "k").first()))
    assert len(seen) == 1
    got = seen.pop()
    assert got[3] == 0.1396875 and got[0] == pytest.approx(np.mean([(b - a) / b for _, a, b in shares]), abs=1e-12)
    odd = lambda *p: D.evidence_metrics(none, none, records([(False, x) for x in p]), "k").first().brier
    assert np.isnan(odd(0.5, float("nan"))) and odd(0.5, None) == 0.25 and odd(None) is None and odd(1e9, 0.0) == 5e17
