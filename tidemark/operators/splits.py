"""Splits, quotas and schedules.

Sequential greedy rules (SP1, SP3, SP10-SP17) decide one item after the
other, so they run on the driver: over aggregates, groups by labels in size,
where items are groups, and over the candidates themselves (SP10, SP11), a
catalogue that has to fit there.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequences import hash_running


def sha(*parts) -> str:
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def components(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """SP2: (key, component): rows that share any identity are connected; component is the least key.

    Each identity links its rows to its least key (a star), so a shared value
    gives as many links as rows. Least keys spread by joins until stable.
    """
    from tidemark.session import written

    long = df.select(key, F.explode(F.array(*[F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in fields])).alias("value")).where("value is not null").distinct()
    long = written(long, "identities")
    now = df.select(key, F.col(key).alias("component")).distinct()
    total = None
    while True:
        by_value = long.join(now, key).groupBy("value").agg(F.min("component").alias("m"))
        nearer = long.join(by_value, "value").groupBy(key).agg(F.min("m").alias("m"))
        step = now.join(nearer, key, "left").select(key, F.least("component", F.coalesce("m", "component")).alias("component"))
        # a component's name is itself a key: jump to that key's component
        jump = step.select(F.col(key).alias("component"), F.col("component").alias("root"))
        now = written(step.join(jump, "component").select(key, F.col("root").alias("component")), "components")
        new = now.agg(F.sum("component")).first()[0]
        if new == total:
            return now
        total = new


def disjoint_halves(groups: DataFrame, component: str, share: float, salt: str) -> DataFrame:
    """SP22: whole components in hash order fill the calibration side up to its share."""
    sizes = groups.groupBy(component).agg(F.count("*").alias("size"))
    ordered = hash_running(sizes, component, "size", salt)
    return ordered.withColumn("side", F.when(F.col("_before") < F.col("_total") * share, "calibration").otherwise("selection")).drop("_before", "_total")


def round_robin(df: DataFrame, label: str, order, limit: int) -> DataFrame:
    """SP21, SP24: one row per label in turn, in hash order, up to a total limit."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("turn", n).orderBy("turn", label).limit(limit)


def stratified_dev(groups: dict[str, Counter], share: float, seed: str) -> set[str]:
    """SP1: greedy multi-label choice of dev groups.

    Each step takes the group that most reduces the squared relative error of
    dev label counts against ``share`` of the totals, ties by hash; a group that
    would leave a label without training rows is passed over.
    """
    total: Counter = Counter()
    for c in groups.values():
        total.update(c)
    target = {k: v * share for k, v in total.items()}
    have: Counter = Counter()
    chosen: set[str] = set()

    def error(counts) -> float:
        return sum(((target[k] - counts[k]) / total[k]) ** 2 for k in total)

    while True:
        now, best = error(have), None
        for g in groups.keys() - chosen:
            c = groups[g]
            if any(total[k] - have[k] - n <= 0 for k, n in c.items()):
                continue
            gain = now - error(have + c)
            if gain > 1e-12 and (best is None or (-gain, sha(seed, g)) < best[:2]):
                best = (-gain, sha(seed, g), g)
        if best is None:
            return chosen
        chosen.add(best[2])
        have.update(groups[best[2]])


def improved_partition(groups: dict[str, Counter], dev: set[str], share: float) -> set[str]:
    """SP3: flip single groups while that lowers the squared error."""
    total: Counter = Counter()
    for c in groups.values():
        total.update(c)

    def error(side: set[str]) -> float:
        have: Counter = Counter()
        for g in side:
            have.update(groups[g])
        return sum(((total[k] * share - have[k]) / total[k]) ** 2 for k in total)

    side, best = set(dev), error(dev)
    moved = True
    while moved:
        moved = False
        for g in sorted(groups):
            trial = side ^ {g}
            if (e := error(trial)) < best - 1e-12:
                side, best, moved = trial, e, True
    return side


def cover(items: DataFrame, key: str, label: str, quota: dict[str, int], salt: str) -> DataFrame:
    """SP5: keys, in the order of their hash, of which some label is below its quota when they come; each kept key counts for those.

    A label below quota counts each key that has it, so the kept keys are the
    first ones, as many as its quota, of each label. ``items`` has a row per key
    and label; the result a row per kept key with its ``place``, at most the sum of
    the quotas.
    """
    place = F.sha2(F.concat_ws(":", F.lit(salt), F.col(key).cast("string")), 256)
    wanted = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    few = items.where(F.col(label).isin(*quota)).select(key, label).distinct().withColumn("place", place)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("place", key))
    return few.withColumn("_r", rank).where(F.col("_r") <= F.element_at(wanted, F.col(label))).select(key, "place").distinct()


def packed_groups(rows: list[tuple[str, int]], most_rows: int, most_size: int) -> list[list[str]]:
    """SP13: in order, start a new batch when a row would break either bound."""
    out: list[list[str]] = [[]]
    size = 0
    for name, n in rows:
        if out[-1] and (len(out[-1]) >= most_rows or size + n > most_size):
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return out if out[-1] else []


def isolated_allocation(candidates: list[tuple[str, str, str]], quota: dict[str, int], seed: str) -> dict[str, list[str]]:
    """SP10, SP11: scarcest label first; (source, label, owner); an owner serves one label only."""
    supply = Counter(label for _, label, _ in candidates)
    owner_of: dict[str, str] = {}
    out: dict[str, list[str]] = {}
    for label in sorted(quota, key=lambda x: (supply[x] - quota[x], x)):
        own = sorted((sha(seed, s), s, o) for s, lab, o in candidates if lab == label)
        out[label] = []
        for _, source, owner in own:
            if len(out[label]) < quota[label] and owner_of.get(owner, label) == label:
                owner_of[owner] = label
                out[label].append(source)
    return out


def schedule(sources: dict[str, list[str]], rounds: int, width: int) -> list[list[str]]:
    """SP15: per round each label leads one scene, the next labels fill it; sources without replacement."""
    labels = sorted(sources)
    stock = {k: list(v) for k, v in sources.items()}
    scenes = []
    for r in range(rounds):
        for i, _ in enumerate(labels):
            picked = [labels[(i + j * (r + 1)) % len(labels)] for j in range(width)]
            picked = list(dict.fromkeys(picked))
            if all(stock[x] for x in picked):
                scenes.append([stock[x].pop(0) for x in picked])
    return scenes


def disjoint_folds(labels: list[str], width: int, folds: int, score) -> list[tuple[str, ...]]:
    """SP17: ``folds`` disjoint sets of ``width`` labels, the best by ``score`` (None: not allowed; lower is better) that fit together.

    Sets go by score; the first choice that can be completed wins, found depth
    first. Labels are a catalogue of some tens.
    """
    rated = [(v, c) for c in itertools.combinations(sorted(labels), width) if (v := score(c)) is not None]
    sets = [frozenset(c) for _, c in sorted(rated)]
    chosen: list[int] = []
    at = 0
    while len(chosen) < folds:
        used = frozenset().union(*(sets[i] for i in chosen))
        fit = next((i for i in range(at, len(sets)) if not used & sets[i]), None) if len(labels) - len(used) >= (folds - len(chosen)) * width else None
        if fit is not None:
            chosen.append(fit)
            at = fit + 1
        elif chosen:
            at = chosen.pop() + 1
        else:
            raise ValueError(f"no {folds} disjoint sets of {width} labels")
    return [tuple(sorted(sets[i])) for i in chosen]


def label_groups(df: DataFrame, group: str, label: str) -> dict[str, Counter]:
    """Label counts per group, collected: the input of SP1 and SP3, groups by labels in size."""
    out: dict[str, Counter] = defaultdict(Counter)
    for r in df.groupBy(group, label).agg(F.count("*").alias("n")).collect():
        out[str(r[0])][str(r[1])] = r.n
    return dict(out)


def diverse_families(df: DataFrame, family: str, category: str, order: list[Column], quota: dict[str, int]) -> list[tuple[str, str]]:
    """SP16: (category, family) picks, a family once, as many per category as its quota; categories take turns in the order of ``quota``.

    Each turn takes the category's best family not yet picked, which repairs
    conflicts between categories; a category without one left while its quota
    isn't met fails. Spark finds each family's best row per category and the first
    families, as many as all quotas together, of each: no more can be looked at.
    """
    total = sum(quota.values())
    best = Window.partitionBy(family, category).orderBy(*order)
    of = df.where(F.col(category).isin(*quota)).withColumn("_b", F.row_number().over(best)).where("_b = 1")
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order, family))
    rows = of.withColumn("_p", place).where(F.col("_p") <= total).select(F.col(category).alias("c"), F.col(family).alias("f"), "_p").orderBy("c", "_p").collect()
    queues: dict[str, list] = {c: [r.f for r in rows if r.c == c][::-1] for c in quota}
    left, used, out = dict(quota), set(), []
    while any(left.values()):
        for c in [c for c in quota if left[c]]:
            while queues[c] and queues[c][-1] in used:
                queues[c].pop()
            if not queues[c]:
                raise ValueError(f"too few families for {c}: {left[c]} missing")
            used.add(queues[c][-1])
            out.append((c, queues[c].pop()))
            left[c] -= 1
    return out


def locked_build(train: DataFrame, test: DataFrame, preserved: DataFrame, group: str, labels: str, identities: list[str], ontology: list[str], share: float, seed: str) -> DataFrame:
    """SP4: all rows with ``split`` (train, dev, test) and ``origin`` (official or preserved).

    Only rows with a label of the ontology stay, their labels cut to it. Official
    test rows are test and nothing else; preserved rows keep their own ``split``;
    official train groups are divided into train and dev with each label's share
    kept. The build fails if official train and test share a group, a preserved
    split is unknown, an identity (a null is none) occurs in two splits, or a label
    of the ontology has no train row.
    """
    from tidemark.operators.audits import leakage

    unknown = preserved.where(F.col("split").isNull() | ~F.col("split").isin("train", "dev", "test")).limit(1).count()
    if unknown:
        raise ValueError("preserved rows without a known split")
    if train.select(group).join(test.select(group), group, "left_semi").limit(1).count():
        raise ValueError("official train and test share a group")
    known = F.array(*map(F.lit, ontology))

    def eligible(df: DataFrame) -> DataFrame:
        return df.withColumn(labels, F.array_sort(F.array_intersect(labels, known))).where(F.size(labels) > 0)

    official = eligible(train)
    dev = stratified_dev(label_groups(official.select(group, F.explode(labels).alias("_label")), group, "_label"), share, seed)
    side = F.when(F.col(group).cast("string").isin(*sorted(dev)), "dev").otherwise("train") if dev else F.lit("train")
    columns = [c for c in train.columns if c != "split"]
    parts = [official.select(*columns, side.alias("split"), F.lit("official").alias("origin")), eligible(test).select(*columns, F.lit("test").alias("split"), F.lit("official").alias("origin")), eligible(preserved).select(*columns, "split", F.lit("preserved").alias("origin"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    shared = leakage(out, "split", identities).limit(1).collect()
    if shared:
        raise ValueError(f"an identity occurs in two splits: {shared[0].asDict()}")
    seen = {r[0] for r in out.where("split = 'train'").select(F.explode(labels)).distinct().collect()}
    if missing := sorted(set(ontology) - seen):
        raise ValueError(f"labels without a train row: {missing}")
    return out


def topup(reserve: DataFrame, keys: list[str], order: list[Column], evaluated: str, accepted: str, target: int, overdraw: float) -> DataFrame:
    """SP9: per key the accepted rows (at most ``target``), how many reserve rows to ask for next, and whether the reserve was used in its order.

    The reserve is frozen: an evaluated row after one that isn't breaks the order
    (``in_order`` is false), and then nothing is asked for. Otherwise the request
    is what is missing times ``overdraw``, rounded up, at most what is left.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = reserve.withColumn("_place", place)
    done, open_ = F.max(F.when(F.col(evaluated), F.col("_place"))), F.min(F.when(~F.col(evaluated), F.col("_place")))
    good = F.least(F.lit(target).cast("bigint"), F.count_if(F.col(evaluated) & F.col(accepted)))
    out = rows.groupBy(*keys).agg(good.alias("accepted"), F.count_if(~F.col(evaluated)).alias("left"), F.coalesce(done < open_, F.lit(True)).alias("in_order"))
    wanted = F.least("left", F.ceil((target - F.col("accepted")) * overdraw).cast("bigint"))
    return out.select(*keys, "accepted", "in_order", F.when(F.col("in_order"), wanted).otherwise(0).alias("request"))


def locked_plan(requests: DataFrame, quota: dict[tuple[str, str], int]) -> DataFrame:
    """SP14: a row per video of requests (video, split, label, location, request): its split, location and sorted requests.

    The plan fails if a video has two splits or two locations, or if a (split,
    label) doesn't have its quota of requests exactly, whether more, fewer or
    unasked for.
    """
    videos = requests.groupBy("video").agg(F.count_distinct("split").alias("_splits"), F.count_distinct("location").alias("_locations"), F.first("split").alias("split"), F.first("location").alias("location"), F.array_sort(F.collect_list(F.struct("label", "request"))).alias("requests"))
    for column, what in (("_splits", "split"), ("_locations", "location")):
        if bad := videos.where(F.col(column) != 1).select("video").limit(1).collect():
            raise ValueError(f"video {bad[0].video} has not one {what}")
    found = {(r.split, r.label): r.n for r in requests.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}  # a row per split and label
    for key in sorted({*found, *quota}):
        if found.get(key, 0) != quota.get(key, 0):
            raise ValueError(f"{key} has {found.get(key, 0)} requests instead of {quota.get(key, 0)}")
    return videos.drop("_splits", "_locations")
