"""How many speakers a recording has: average linkage on cosine distance, the count chosen by silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a greater count must gain, and the least silhouette of any.
TOLERANCE, LEAST_SILHOUETTE = 0.02, 0.25


def cosine_distances(x: np.ndarray) -> np.ndarray:
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    out = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(out, 0)
    return out


def linkage(distances: np.ndarray, least: int, most: int) -> dict[int, np.ndarray]:
    """The partitions into ``most`` down to ``least`` clusters by average linkage; number of clusters -> cluster of each row, by first row.

    Clusters with the least mean distance merge, of equal ones the earliest pair.
    The mean to a merged cluster is that to its parts weighted by their sizes.
    """
    n = len(distances)
    mean = distances.astype(float)
    np.fill_diagonal(mean, np.inf)
    sizes, cluster = np.ones(n), np.arange(n)
    out = {}
    for count in range(n, least - 1, -1):
        if count <= most:
            out[count] = np.unique(cluster, return_inverse=True)[1]
        if count == least:
            break
        a, b = np.unravel_index(np.argmin(mean), mean.shape)
        a, b = min(a, b), max(a, b)
        joined = (sizes[a] * mean[a] + sizes[b] * mean[b]) / (sizes[a] + sizes[b])
        mean[a], mean[:, a] = joined, joined
        mean[b], mean[:, b], mean[a, a] = np.inf, np.inf, np.inf
        sizes[a] += sizes[b]
        cluster[cluster == b] = a
    return out


def silhouette(distances: np.ndarray, cluster: np.ndarray) -> float:
    """The mean over rows of (b - a) / max(a, b): a to the own cluster's others, b to the nearest other cluster; alone in a cluster: 0."""
    member = np.eye(cluster.max() + 1)[cluster]
    sizes = member.sum(0)
    sums = distances @ member
    own = sizes[cluster]
    a = sums[np.arange(len(cluster)), cluster] / np.maximum(own - 1, 1)
    other = np.where(member > 0, np.inf, sums / sizes)
    b = other.min(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where((own > 1) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
    return float(s.mean())


def speakers(x: np.ndarray, most: int, least_windows: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float | None]:
    """The speaker of each window, and the best silhouette among allowed counts.

    Counts from two on are allowed if each cluster has ``least_windows``; the
    least count within ``tolerance`` of the best silhouette wins; one speaker if
    none is allowed or the best is under ``LEAST_SILHOUETTE``.
    """
    most = min(most, len(x) // max(1, least_windows))
    if most < 2:
        return np.zeros(len(x), int), None
    distances = cosine_distances(x)
    scores = {k: (silhouette(distances, c), c) for k, c in linkage(distances, 2, most).items() if np.bincount(c).min() >= least_windows}
    best = max((s for s, _ in scores.values()), default=None)
    if best is None or best < LEAST_SILHOUETTE:
        return np.zeros(len(x), int), best
    return scores[min(k for k, (s, _) in scores.items() if s >= best - tolerance)][1], best


def speaker_windows(df: DataFrame, keys: list[str], order: str, features: str, most: int, least_windows: int) -> DataFrame:
    """X8 per recording: (keys, order, speaker, speakers, silhouette); a recording's windows are as many as it is long."""
    kinds = dict(df.dtypes)

    def run(key, p):
        p = p.sort_values(order)
        found, best = speakers(np.stack(p[features].to_list()).astype(float), most, least_windows)
        return pd.DataFrame({**{k: v for k, v in zip(keys, key)}, order: p[order].to_numpy(), "speaker": found, "speakers": int(found.max()) + 1, "silhouette": best}).astype({"silhouette": "float64"})

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, order]) + ", speaker bigint, speakers bigint, silhouette double"
    return df.select(*keys, order, F.col(features)).groupBy(*keys).applyInPandas(run, schema)
