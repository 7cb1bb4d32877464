"""Queries without SQL take all rows of a group."""

from collections import Counter, defaultdict

from tidemark.operators.matching import iou
from tidemark.plans import REGISTRY
from tidemark.plans.registry import timeline

SF = "/root/testdata/sf0.001"


def groups(spark, *keys):
    """Events of each group as (onset, off, conf, event_id)."""
    out = defaultdict(list)
    for r in timeline(spark, SF).collect():
        out[tuple(r[k] for k in keys)].append((r.onset, r.off, r.conf, r.event_id))
    return out


def test_suppression_keeps_what_no_kept_event_overlaps(spark):
    kept = defaultdict(set)
    for r in REGISTRY["non_maximum"].run(spark, SF).collect():
        kept[r.scene, r.label].add(r.event_id)
    for key, events in groups(spark, "scene", "label").items():
        for e in events:
            above = [o for o in events if o[3] in kept[key] and o[3] != e[3] and iou(o, e) >= 0.1 and o[2] >= e[2]]
            assert (e[3] in kept[key]) == (not above)


def test_matchings_equal_plain_loops(spark):
    sides = {k: ([e for e in v if e[3] % 2 == 0], [e for e in v if e[3] % 2]) for k, v in groups(spark, "scene").items()}
    got = {(r.scene, r.rule): (r.predicted, r.gold, r.matched, round(r.iou, 6)) for r in REGISTRY["greedy_matchings"].run(spark, SF).collect()}
    for (scene,), (p, g) in sides.items():
        for rule in ("onset", "confidence", "pairs"):
            free, total, n = set(range(len(g))), 0.0, 0
            p, g = sorted(p, key=lambda e: e[:3]), sorted(g, key=lambda e: e[:2])
            if rule == "pairs":
                left = set(range(len(p)))
                for v, i, j in sorted((-iou(x, y), i, j) for i, x in enumerate(p) for j, y in enumerate(g)):
                    if -v >= 0.1 and i in left and j in free:
                        left.discard(i), free.discard(j)
                        total, n = total - v, n + 1
            else:
                for x in sorted(p, key=lambda e: e[0] if rule == "onset" else -e[2]):
                    best = max(((iou(x, g[j]), -j) for j in free), default=(0.0, 0))
                    if free and best[0] >= 0.1:
                        free.discard(-best[1])
                        total, n = total + best[0], n + 1
            assert got[scene, rule] == (len(p), len(g), n, round(total, 6))


def test_greatest_matchings_are_greatest(spark):
    got = {(r.scene, r.label): (r.predicted, r.gold, r.matched) for r in REGISTRY["greatest_matching"].run(spark, SF).collect()}
    for key, events in groups(spark, "scene", "label").items():
        p, g = [e for e in events if e[3] % 2 == 0], [e for e in events if e[3] % 2]
        sets = {frozenset()}  # sets of gold that some matching of the predictions so far takes
        for x in p:
            near = [j for j, y in enumerate(g) if iou(x, y) >= 0.1]
            sets |= {s | {j} for s in sets for j in near if j not in s}
        assert got[key] == (len(p), len(g), max(map(len, sets)))


def test_selections_keep_their_rules(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "lang").collect()]
    side = {r.source: r.side for r in REGISTRY["stratified_split"].run(spark, SF).collect()}
    total, dev = Counter(lang for _, lang in rows), Counter(lang for source, lang in rows if side[source] == "dev")
    assert set(side) == {s for s, _ in rows} and all(dev[x] < total[x] for x in total)
    labels = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().collect():
        labels[str(r[0])].add(r[1])
    kept = {r.user_id for r in REGISTRY["quota_cover"].run(spark, SF).collect()}
    have, every = (Counter(x for u in users for x in labels[u]) for users in (kept, labels))
    assert all(have[x] >= min(12, every[x]) for x in every)
    scenes = [r.sources.split(",") for r in REGISTRY["isolated_schedule"].run(spark, SF).collect()]
    used = [s for scene in scenes for s in scene]
    assert len(used) == len(set(used)) and all(len({int(s) % 6 for s in scene}) == len(scene) for scene in scenes)


def test_unique_starts_and_boundary_errors(spark):
    starts = defaultdict(list)
    for r in REGISTRY["unique_starts"].run(spark, SF).collect():
        assert r.placed == (r.start is not None)
        starts[r.scene].append(r.start)
    for scene in starts.values():
        placed = [x for x in scene if x is not None]
        assert len(set(placed)) == len(placed) == min(len(scene), 1440)
    got = {r.scene: r.error for r in REGISTRY["boundary_error"].run(spark, SF).collect()}
    for (scene,), events in sorted(groups(spark, "scene").items())[:15]:
        a, b = (sorted(e[0] / 86400 for e in events if e[3] % 2 == k) for k in (0, 1))
        row = [10.0 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [10.0 * i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 10, new[-1] + 10, row[j - 1] + abs(x - y)))
            row = new
        assert abs(got[scene] - row[-1] / max(len(a), len(b), 1)) < 1e-6


def test_cheapest_assignment_takes_all_events_of_a_scene(spark, tmp_path):
    events = [(i, 1, "click", f"2024-01-{1 + i:02d} 00:00:00", 1.0) for i in range(25)] + [(100 + i, 2, "view", f"2024-02-0{1 + i} 00:00:00", 1.0) for i in range(2)] + [(200, 3, "view", "2024-03-01 00:00:00", 1.0)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, ts string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = REGISTRY["cheapest_assignment"].run(spark, str(tmp_path)).collect()
    assert Counter(r.scene for r in got) == {1: 12, 2: 1}
    assert {r.right for r in got if r.scene == 1} == set(range(1, 25, 2)) and len({r.left for r in got}) == len(got)
    assert sum(abs(r.left - r.right) for r in got if r.scene == 1) == 12  # days: each with a neighbour


def test_all_turns_vote_and_the_whole_first_turn_is_quoted(spark, tmp_path):
    turns = ["a b c d e f", "a b c d e f", "a b x d e f", "a b x d e f", "z a b x d e f"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = REGISTRY["word_errors"].run(spark, str(tmp_path)).collect()
    assert (r.errors, r.words) == (3, 31)  # the voted words are a b x d e f
    assert (r.turns, r.near, r.exact) == (5, 5, 2)
    assert (r.quote_start, round(r.quote_ratio, 4)) == (1, 0.9091)  # by characters
