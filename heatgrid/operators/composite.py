"""Many scene observations -> one value per pixel."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.operators.quantiles import HOT_ROWS, quantile_columns

PIXEL = ("year", "row", "col")


def run_starts(keys: Sequence[pa.Array]) -> np.ndarray:
    """Positions where a run of equal keys begins; NULL equals NULL."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _medians(values: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """Median of the values that are there, for each of n groups; NULL where none is."""
    there = values.is_valid().to_numpy(zero_copy_only=False)
    v, g = values.drop_null().to_numpy(zero_copy_only=False), group[there]
    v = v[np.lexsort((v, g))]
    count = np.bincount(g, minlength=n)
    has = count > 0
    first, pos = (np.cumsum(count) - count)[has], (count[has] - 1) * 0.5
    lo, hi = v[first + np.floor(pos).astype(np.int64)], v[first + np.ceil(pos).astype(np.int64)]
    out = np.zeros(n)
    out[has] = lo + (hi - lo) * (pos - np.floor(pos))
    return pa.array(out, mask=~has)


def _modes(labels: pa.Array, group: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The most frequent label of each group and its count; ties: the smallest, NULL last."""
    places = pc.array_sort_indices(labels, null_placement="at_end").to_numpy()
    order = places[np.argsort(group[places], kind="stable")]
    ordered, g = labels.take(pa.array(order)), group[order]
    at = run_starts([pa.array(g), ordered])
    n = np.diff(np.append(at, len(g)))
    best = np.lexsort((np.arange(len(at)), -n, g[at]))
    best = best[np.flatnonzero(np.diff(g[at][best], prepend=-1))]
    return ordered.take(pa.array(at[best])), pa.array(n[best].astype(np.int64))


def _pixels(n_keys: int, n_bands: int, clear: bool, label: bool, schema: pa.Schema) -> Callable:
    """Medians, clear counts and modes of whole pixels, from rows in order of pixel; an unfinished pixel waits for the next batch."""

    def whole(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        cols = [c.combine_chunks() for c in t.columns]
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(t))))
        out = [k.take(pa.array(at)) for k in cols[:n_keys]]
        out += [_medians(v, group, len(at)) for v in cols[n_keys:n_keys + n_bands]]
        if clear:
            seen = pc.fill_null(cols[n_keys + n_bands], False).to_numpy(zero_copy_only=False)
            out.append(pa.array(np.bincount(group[seen], minlength=len(at)).astype(np.int64)))
        if label:
            out += _modes(cols[-1], group)
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([*waiting, b])
            at = run_starts([c.combine_chunks() for c in t.columns[:n_keys]])
            if len(at) > 1:
                yield whole(t.slice(0, int(at[-1])), at[:-1])
            waiting = t.slice(int(at[-1])).combine_chunks().to_batches()
        if waiting:
            yield whole(pa.Table.from_batches(waiting), np.zeros(1, dtype=np.int64))

    return pixels


def median_composite(
    obs: DataFrame,
    bands: dict[str, Column],
    clear: Column | None = None,
    dn: str | None = None,
    keys: Sequence[str] = PIXEL,
    hot_rows: int = HOT_ROWS,
    label: str | None = None,
    mode: str = "mode",
) -> DataFrame:
    """Exact per-pixel median of each masked band, with the clear count and the mode of `label` (as `mode_composite`) beside it.

    Observations move once, to their pixel, and are read there in order of pixel. Pixels above `hot_rows` are split off
    before that (at most rows / hot_rows of them) and take the bucketed way.
    """
    keys = list(keys)
    masked = obs.select(
        *keys, *[v.cast("double").alias(b) for b, v in bands.items()],
        *([F.when(clear, F.col(dn)).isNotNull().alias("_clear")] if clear is not None else []),
        *([F.col(label).alias("_label")] if label else []),
    )
    hot = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    fields = [masked.schema[k] for k in keys] + [T.StructField(b, T.DoubleType()) for b in bands]
    if clear is not None:
        fields.append(T.StructField("clear_count", T.LongType()))
    if label:
        fields += [T.StructField(mode, masked.schema["_label"].dataType), T.StructField("mode_count", T.LongType())]
    out = T.StructType(fields)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])
    cold = (
        masked.join(F.broadcast(hot), keys, "left_anti").repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_pixels(len(keys), len(bands), clear is not None, label is not None, arrow), out))
    heavy = masked.join(F.broadcast(hot), keys, "left_semi")
    warm = heavy.groupBy(*keys).agg(*([F.count_if("_clear").alias("clear_count")] if clear is not None else [F.count(F.lit(1)).alias("_n")]))
    warm = warm.join(quantile_columns(heavy, keys, {b: [b] for b in bands}, [0.5]), keys, "left")
    if label:
        warm = warm.join(mode_composite(heavy, "_label", keys, mode), keys)
    return cold.unionByName(warm.select(*cold.columns))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind.simpleString()]


def mode_composite(obs: DataFrame, label: str, keys: Sequence[str] = PIXEL, out: str = "mode") -> DataFrame:
    """Most frequent label, the smallest on ties. Labels are counted before any key is gathered."""
    counts = obs.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg"))).alias("b")
    return counts.groupBy(*keys).agg(best).select(
        *keys, (-F.col("b.neg")).alias(out), F.col("b.n").alias("mode_count")
    )


def scene_table(obs: DataFrame) -> DataFrame:
    """One row per scene and day with its cloud share and pixel count."""
    return obs.groupBy("year", "scene_id", F.to_date("ts").alias("day")).agg(
        F.min("cloud_pct").alias("cloud_pct"), F.count(F.lit(1)).alias("n_px")
    )


def scene_filter(scenes: DataFrame, first: tuple[int, int], last: tuple[int, int], max_cloud: int) -> DataFrame:
    """Scenes of a month/day window under a cloud bound, clearest first."""
    md = F.month("day") * 100 + F.dayofmonth("day")
    keep = md.between(first[0] * 100 + first[1], last[0] * 100 + last[1]) & (F.col("cloud_pct") < max_cloud)
    return scenes.where(keep).orderBy("cloud_pct", "scene_id", "day")


def best_scene(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("year").agg(
        F.min(F.struct("cloud_pct", "scene_id")).alias("b")
    ).select("year", F.col("b.scene_id").alias("scene_id"), F.col("b.cloud_pct").alias("cloud_pct"))


def dedupe_scenes(scenes: DataFrame, tile: Column) -> DataFrame:
    """One scene per (tile, day): lowest cloud, then lowest id. A minimum combines map-side."""
    return (
        scenes.withColumn("tile", tile).groupBy("tile", "day")
        .agg(F.min(F.struct("cloud_pct", "scene_id")).alias("b"))
        .select("tile", "day", F.col("b.scene_id").alias("scene_id"), F.col("b.cloud_pct").alias("cloud_pct"))
    )


def cell_accumulators(obs: DataFrame, keys: Sequence[str], value: Column, clear: Column) -> DataFrame:
    """Mergeable count/sum/sum of squares/min/max per key; combining happens before the shuffle."""
    v = F.when(clear, value)
    return obs.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
    )


def export_guard(labelled: DataFrame, expected: int, keys: Sequence[str] = ("year",), min_share: float = 0.5) -> DataFrame:
    """Cells present, their share of the expected grid, and whether the product may be used."""
    return labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).select(
        *keys, "n_cells", (F.col("n_cells") / F.lit(expected)).alias("coverage"),
        (F.col("n_cells") / F.lit(expected) >= min_share).alias("ok"),
    )


def class_histogram(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def first_in_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
