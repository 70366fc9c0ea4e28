"""Folds over ordered rows whose next step depends on what was kept.

Each runs in one pass over a group's rows, in arrays of numbers; texts and images stay on the JVM's side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ..sources.frames import INTERVAL, THRESHOLD


def interval_positions(times: np.ndarray, interval: float) -> np.ndarray:
    """The first of the sorted times, then each that lies interval or more after the last one taken."""
    kept, at = [], 0
    while at < len(times):
        kept.append(at)
        reach = times[at] + interval
        at = max(at + 1, int(np.searchsorted(times, reach, "left")))
        while at < len(times) and times[at] - times[kept[-1]] < interval:  # the sum may round otherwise than the difference
            at += 1
    return np.array(kept, np.int64)


def change_positions(features: np.ndarray, threshold: float, difference: Callable = lambda a, b: float(np.mean(np.abs(a - b)))) -> np.ndarray:
    """The first sample, then each that differs from the one before, or from the last one kept, by more than threshold."""
    kept: list[int] = []
    for i, sample in enumerate(features):
        if not kept or difference(features[i - 1], sample) > threshold or difference(features[kept[-1]], sample) > threshold:
            kept.append(i)
    return np.array(kept, np.int64)


def _keep(samples: DataFrame, positions: Callable[[pd.DataFrame], np.ndarray], columns: list[str]) -> DataFrame:
    schema = StructType([StructField(f.name, f.dataType) for f in samples.select(columns).schema])

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "ordinal"], kind="stable")
        return group.iloc[positions(group)][columns]

    return samples.groupBy("video_id").applyInPandas(task, schema)


def sample_interval(samples: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """video_id, ordinal, ts of the samples that are taken."""
    return _keep(samples.select("video_id", "ordinal", "ts"), lambda g: interval_positions(g["ts"].to_numpy(), interval), ["video_id", "ordinal", "ts"])


def select_changes(samples: DataFrame, threshold: float = THRESHOLD, feature: str = "value") -> DataFrame:
    """video_id, ordinal, ts of the samples that begin something new.  feature: a number or an array of numbers."""

    def positions(group: pd.DataFrame) -> np.ndarray:
        return change_positions(np.stack([np.atleast_1d(np.asarray(x, float)) for x in group[feature]]), threshold)

    return _keep(samples.select("video_id", "ordinal", "ts", feature), positions, ["video_id", "ordinal", "ts"])


def pack_positions(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Next-fit packing: the chunk of each record; a chunk's records and one separator each stay within limit."""
    out, chunk, used = np.zeros(len(lengths), np.int64), 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i and used + n + 1 > limit:
            chunk, used = chunk + 1, 0
        used += n + 1
        out[i] = chunk
    return out


def pack_next_fit(records: DataFrame, limit: int = 50_000) -> DataFrame:
    """Records (video_id, ordinal, length) with their `chunk`, from 0."""

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal", kind="stable")
        return group.assign(chunk=pack_positions(group["length"].to_numpy(), limit).astype(np.int32))[["video_id", "ordinal", "length", "chunk"]]

    base = records.select("video_id", "ordinal", "length")
    schema = ", ".join(f"{n} {t}" for n, t in base.dtypes) + ", chunk int"
    return base.groupBy("video_id").applyInPandas(task, schema)
