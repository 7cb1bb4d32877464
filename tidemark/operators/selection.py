"""Selections over a catalogue: a few rows per route that cover what is asked for, and balanced groups of classes.

Spark reduces the rows to what can matter (candidates per route and coverage,
counts per pair of classes); the search runs over what is left, whose size
depends on the numbers of routes, bits and classes alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import assignment, maximum_matching

#: Candidates of a (route, coverage mask), options of a route per mask, and partial selections per mask.
CANDIDATES, OPTIONS, BEAM = 16, 16, 32
#: Starts of the search for balanced groups.
STARTS = 16


@dataclass(frozen=True)
class Option:
    """Some rows, the bits they cover, and their labels and tiers."""

    rows: tuple = ()
    mask: int = 0
    labels: frozenset = field(default_factory=frozenset)
    tiers: frozenset = field(default_factory=frozenset)
    stable: str = ""

    def __or__(self, other: Option) -> Option:
        return Option(self.rows + other.rows, self.mask | other.mask, self.labels | other.labels, self.tiers | other.tiers, hashlib.sha256((self.stable + other.stable).encode()).hexdigest())

    @property
    def rank(self) -> tuple:
        return -len(self.labels), -len(self.tiers), self.stable


def pruned(options: Iterable[Option], width: int) -> list[Option]:
    """For each mask the best ``width`` options."""
    by_mask: dict[int, list[Option]] = {}
    for o in options:
        by_mask.setdefault(o.mask, []).append(o)
    return [o for mask in sorted(by_mask) for o in sorted(by_mask[mask], key=lambda o: o.rank)[:width]]


def diverse(options: list[Option], most: int) -> list[Option]:
    """Up to ``most``, each time the one with most labels, then tiers, not yet seen; of equal ones by hash."""
    left, out, labels, tiers = list(options), [], frozenset(), frozenset()
    while left and len(out) < most:
        best = min(left, key=lambda o: (-len(o.labels - labels), -len(o.tiers - tiers), o.stable))
        left.remove(best)
        out.append(best)
        labels, tiers = labels | best.labels, tiers | best.tiers
    return out


def route_candidates(rows: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """SP12: of (row, route, mask, labels, tiers) the rows that can be chosen: per route and mask up to ``most`` diverse ones.

    Rows that agree in labels and tiers differ by their hash alone, so ``most`` of
    each kind are enough; they are cut by a window before kinds meet in a group.
    """
    kind = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("labels", "tiers")]
    keyed = rows.select("row", "route", "mask", *kind, F.sha2(F.col("row").cast("string"), 256).alias("stable"))
    n = F.row_number().over(Window.partitionBy("route", "mask", "labels", "tiers").orderBy("stable", "row"))
    few = keyed.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")

    def run(p):
        options = [Option((i,), int(m), frozenset(a), frozenset(t), s) for i, m, a, t, s in zip(range(len(p)), p["mask"], p["labels"], p["tiers"], p["stable"])]
        return p.iloc[[o.rows[0] for o in diverse(options, most)]]

    return few.groupBy("route", "mask").applyInPandas(run, few.schema)


def stratified(rows: DataFrame, per_route: int, wanted: list[int]) -> pd.DataFrame:
    """SP12: (route, row, label) of ``per_route`` rows of each route (all, if it has fewer).

    The selection covers most groups of bits of ``wanted`` (earlier ones first),
    then most labels, then most tiers, then has the least hash. Partial selections
    of each mask are a beam of BEAM; a route offers its OPTIONS best combinations
    per mask. ``label`` names one label per row, all different if there is such a
    choice. Rows are collected as candidates only (at most 16 a route and mask).
    """
    found = route_candidates(rows).orderBy("route", "stable").toPandas()
    beam = [Option()]
    for _, p in found.groupby("route", sort=True):
        single = [Option((r,), int(m), frozenset(a), frozenset(t), s) for r, m, a, t, s in zip(p["row"], p["mask"], p["labels"], p["tiers"], p["stable"])]
        sets = []
        for some in combinations(sorted(single, key=lambda o: o.stable), min(per_route, len(single))):
            whole = Option()
            for o in some:
                whole = whole | o
            sets.append(whole)
        options = pruned(sets, OPTIONS)
        beam = pruned((b | o for b in beam for o in options), BEAM)
    best = min(beam, key=lambda o: (*(-(o.mask & w).bit_count() for w in wanted), *o.rank))
    of = found.set_index("row")
    names = sorted(best.labels)
    # rows look for labels; the matching gives each label at most one row
    partner = maximum_matching([[names.index(x) for x in sorted(of.labels[r])] for r in best.rows], len(names))
    label = {i: names[j] for j, i in enumerate(partner) if i >= 0}
    out = [(of.route[r], r, label.get(i, min(of.labels[r], default=None))) for i, r in enumerate(best.rows)]
    return pd.DataFrame(out, columns=["route", "row", "label"]).sort_values(["route", "row"], ignore_index=True)


def rank_weighted_confusions(ranked: DataFrame, most: int = 10) -> DataFrame:
    """SP23: (label, other, weight): how high other labels rank for rows of a label, a mean per row.

    ``ranked`` has (label, others): labels by falling score. The n-th counts
    1 / log2(n + 1), up to ``most``; a row's own label counts nothing.
    """
    n = ranked.groupBy("label").agg(F.count("*").alias("n"))
    places = ranked.select("label", F.posexplode(F.slice("others", 1, most)).alias("place", "other")).where("label <> other")
    sums = places.groupBy("label", "other").agg(F.sum(1 / F.log2(F.col("place") + 2)).alias("weight"))
    return sums.join(n, "label").select("label", "other", (F.col("weight") / F.col("n")).alias("weight"))


def affinities(confusion: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SP23: four fifths of the symmetric confusion, scaled to one, and a fifth of the likeness of the classes' vectors; one on the diagonal."""
    both = (confusion + confusion.T) / 2
    unit = weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    like = np.maximum(unit @ unit.T, 0)
    np.fill_diagonal(like, 0)
    out = 0.8 * both / max(both.max(), 1e-12) + 0.2 * like
    np.fill_diagonal(out, 1)
    return out


def within_share(affinity: np.ndarray, group: np.ndarray) -> float:
    """How much of the affinity of different classes lies inside groups."""
    off = affinity - np.diag(np.diag(affinity))
    return float(off[group[:, None] == group[None]].sum() / max(off.sum(), 1e-12))


def spectral(affinity: np.ndarray, dimensions: int) -> np.ndarray:
    """Unit rows of the leading eigenvectors of the normalised affinity."""
    degree = np.sqrt(np.maximum(affinity.sum(1), 1e-12))
    vectors = np.linalg.eigh(affinity / degree[:, None] / degree[None])[1][:, -dimensions:]
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def balanced_groups(affinity: np.ndarray, groups: int, rounds: int = 30) -> np.ndarray:
    """SP23: the group of each class, sizes at most one apart, of classes that lie together.

    From up to STARTS classes as the first centre, further ones are the farthest from those
    chosen; then classes are assigned to the centres' places at least cost, and
    centres move to their classes' mean, until nothing changes. The start with
    the greatest share inside groups wins.
    """
    n = len(affinity)
    if n < groups:
        raise ValueError("more groups than classes")
    x = spectral(affinity, groups)
    places = np.arange(n) % groups  # sizes at most one apart
    best, share = None, -1.0
    for first in range(0, n, -(-n // STARTS)):
        chosen = [first]
        while len(chosen) < groups:
            near = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
            chosen.append(int(near.argmax()))
        centres, group = x[chosen], None
        for _ in range(rounds):
            cost = ((x[:, None] - centres[None]) ** 2).sum(2)
            new = places[assignment(cost[:, places])]
            if group is not None and (new == group).all():
                break
            group = new
            centres = np.stack([x[group == g].mean(0) for g in range(groups)])
        if (s := within_share(affinity, group)) > share + 1e-12:
            best, share = group, s
    return best
