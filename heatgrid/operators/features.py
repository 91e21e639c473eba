"""The raw predictor stack of the frozen feature schema, for any subset of years at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.functions.cells import nudge
from heatgrid.operators import focal as N

# Fixed values of the feature schema.
BASES = ("ndvi", "ndbi", "vegetation_cover", "ndmi", "bsi", "dist_road_m", "dist_vegetation_m", "dist_building_m")
STD_BANDS = ("ndvi", "ndbi", "ndre", "ndmi", "mndwi", "bsi", "vegetation_cover")
MEAN_BANDS = ("mndwi", "ndre")
RANGE_BANDS = ("ndvi", "ndbi")
WINDOWS = (3, 5, 11)
LANDUSE = (1, 2, 3, 4, 5, 6, 7, 8)

#: Rows of a batch that goes back to Spark, some 1 kB each.
BATCH_ROWS = 8192


def feature_flags() -> dict[str, Column]:
    """What the disks count: cells at all, cells on a feature, cells of each land use."""
    on = {n: F.coalesce(F.col(f"dist_{d}_m") == 0, F.lit(False))
          for n, d in (("building", "building"), ("road", "road"), ("vegetation", "vegetation"))}
    lu = {f"lu{k}": F.coalesce(F.col("landuse_class") == k, F.lit(False)) for k in LANDUSE}
    return {"cell": F.lit(True), **on, **lu}


def landuse_sql(radius_m: int) -> dict[str, str]:
    """Share of each class, the dominant one (the lowest code on ties) and the entropy; 0 when none."""
    r = N.radius_px(radius_m)
    n = {k: f"lu{k}_n{r}" for k in LANDUSE}
    total = "(" + " + ".join(n.values()) + ")"
    p = {k: f"coalesce({N.ratio(x, total)}, 0D)" for k, x in n.items()}
    out = {f"landuse_frac_{k}_{radius_m}m": p[k] for k in LANDUSE}
    most = f"greatest({', '.join(n.values())})"
    out[f"landuse_dominant_{radius_m}m"] = f"case when {total} = 0 then 0 " + " ".join(
        f"when {x} = {most} then {k}" for k, x in n.items()) + " end"
    out[f"landuse_entropy_{radius_m}m"] = "-(" + " + ".join(
        f"case when {n[k]} > 0 then {p[k]} * ln({p[k]}) else 0D end" for k in LANDUSE) + ")"
    return out


def settled(x: np.ndarray, digits: int) -> np.ndarray:
    """Doubles as `plans.registry.finish` rounds them: nudged, then halves away from zero; those near a half by their decimals."""
    y, unit = x + nudge(digits), 10.0 ** digits
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(y) * unit
        out = np.where(np.isfinite(y), np.copysign(np.floor(scaled + 0.5) / unit, y), y)
        near = np.abs(scaled + 0.5 - np.round(scaled + 0.5)) < 1e-6 + scaled * 1e-15
    for i in np.flatnonzero(np.isfinite(y) & (near | (scaled > 2.0 ** 44))):
        out[i] = float(Decimal(repr(float(y[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
    return out + 0.0


def _ratio(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return total / n, n > 0


class _Windows(NamedTuple):
    """What a tile's windows are: columns added up over disks and squares of the same block and over free squares, those whose extremes are wanted.

    `disk_counts` and `counts` say where in the packed columns the counts of flags and of valid values are.
    """

    disk: Sequence[str]
    block: Sequence[str]
    free: Sequence[str]
    extremes: Sequence[str]
    radii_m: Sequence[int]
    disk_counts: Mapping[str, tuple[str, int, int]]
    counts: Mapping[str, tuple[str, int, int]]
    contrasts: Sequence[str] = ("ndvi", "ndbi")

    @property
    def radii(self) -> list[int]:
        return [N.radius_px(m) for m in self.radii_m]

    def feature_names(self) -> list[str]:
        out = []
        for w in WINDOWS:
            out += [*[f"{v}_mean{w}" for v in BASES], *[f"{v}_std{w}" for v in STD_BANDS], *[f"{v}_mean{w}" for v in MEAN_BANDS], *[f"{v}_range{w}" for v in RANGE_BANDS]]
        for m in self.radii_m:
            out += [*[f"{n}_pixel_fraction_{m}m" for n in ("building", "road", "vegetation")], f"vegetation_cover_mean_{m}m", *[f"{v}_contrast_{m}m" for v in self.contrasts]]
            out += [*[f"landuse_frac_{k}_{m}m" for k in LANDUSE], f"landuse_dominant_{m}m", f"landuse_entropy_{m}m"]
        return out

    def features(self, own: Mapping, sums: Mapping, known: Mapping) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
        """Name -> values, and where they are not NULL. `landuse_sql` says the same of land use in SQL."""
        out = {}

        def counts(at, form, end):
            return {v: (sums[form.format(p, end)] >> shift) & mask for v, (p, shift, mask) in at.items()}

        for w in WINDOWS:
            m, fr = counts(self.counts, "_M_{}_{}", w), counts(self.counts, "_F_{}_{}", w)
            out |= {f"{v}_mean{w}": _ratio(sums[f"_M_{v}_{w}"], m[v]) for v in BASES}
            for v in STD_BANDS:
                mean, valid = _ratio(sums[f"_F_{v}_{w}"], fr[v])
                out[f"{v}_std{w}"] = np.sqrt(np.maximum(_ratio(sums[f"_F__sq_{v}_{w}"], fr[v])[0] - mean * mean, 0.0)), valid
            out |= {f"{v}_mean{w}": _ratio(sums[f"_F_{v}_{w}"], fr[v]) for v in MEAN_BANDS}
            out |= {f"{v}_range{w}": (sums[f"_maxs_{v}_{w}"] - sums[f"_mins_{v}_{w}"], known[f"{v}_range{w}"]) for v in RANGE_BANDS}
        for m, r in zip(self.radii_m, self.radii):
            n = counts(self.disk_counts, "_d_{}_{}", r)
            mean = {v: _ratio(sums[f"_d_{v}_{r}"], n[f"_v_{v}"]) for v in ("vegetation_cover", *self.contrasts)}
            out |= {f"{f}_pixel_fraction_{m}m": (n[f] / n["cell"], None) for f in ("building", "road", "vegetation")}
            out[f"vegetation_cover_mean_{m}m"] = mean["vegetation_cover"]
            out |= {f"{v}_contrast_{m}m": (own[v][0] - mean[v][0], own[v][1] & mean[v][1]) for v in self.contrasts}
            lu = np.stack([n[f"lu{k}"] for k in LANDUSE])
            total = lu.sum(axis=0)
            p = np.where(total > 0, lu / total, 0.0)
            out |= {f"landuse_frac_{k}_{m}m": (x, None) for k, x in zip(LANDUSE, p)}
            out[f"landuse_dominant_{m}m"] = np.where(total > 0, np.array(LANDUSE)[lu.argmax(axis=0)], 0).astype(np.int32), None
            out[f"landuse_entropy_{m}m"] = -sum((np.where(k > 0, x * np.log(x), 0.0) for k, x in zip(lu, p)), np.zeros(len(total))), None
        return {n: out[n] for n in self.feature_names()}


def _tile_features(keep: Sequence[str], whole: Sequence[str], windows: _Windows, size: int, digits: int | None) -> Callable:
    """`keep` and all features of the own cells of a tile, from these and its margin; NULL counts as zero, `_sq_` columns are made here."""

    def added(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        row, col = (t.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
        own = (row // size == key[1].as_py()) & (col // size == key[2].as_py())
        place = np.cumsum(own) - 1
        read = [c for c in dict.fromkeys([*windows.disk, *windows.block, *windows.free]) if not c.startswith("_sq_")]
        value = {c: t.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64 if c in whole else np.float64) for c in read}
        value |= {c: value[c[4:]] * value[c[4:]] for c in windows.free if c.startswith("_sq_")}
        made, known = {}, {}

        def put(tag, columns, rows, sums):
            laid, mine = N.Laid(row[rows], col[rows]), np.flatnonzero(own[rows])
            for kind in (whole, None):
                some = [c for c in columns if (c in whole) == (kind is whole)]
                for reach, grid in sums(laid.out(np.stack([value[c][rows] for c in some]))).items() if some else ():
                    for c, x in zip(some, laid.back(grid, mine)):
                        made.setdefault(f"{tag}_{c}_{reach}", np.zeros(int(own.sum()), dtype=x.dtype))[place[rows][mine]] = x

        if not own.any():
            return pa.Table.from_batches([], pa.schema([*[t.schema.field(c) for c in keep], *[
                pa.field(n, pa.int32() if n.startswith("landuse_dominant") else pa.float64()) for n in windows.feature_names()]]))
        code = t.column("block_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        everywhere = np.arange(len(row))
        with np.errstate(invalid="ignore", over="ignore"):
            for b in np.unique(code[own]):
                rows = np.flatnonzero(code == b)
                put("_d", windows.disk, rows, lambda g: N.disks(g, windows.radii))
                put("_M", windows.block, rows, lambda g: N.squares(g, WINDOWS))
            put("_F", windows.free, everywhere, lambda g: N.squares(g, WINDOWS))
            laid, mine = N.Laid(row, col), np.flatnonzero(own)
            valid = np.stack([t.column(c).is_valid().to_numpy() for c in windows.extremes])
            x = np.stack([value[c] for c in windows.extremes])
            # NaN is above all numbers, as in SQL
            for f, rule, none in (("max", np.maximum, -np.inf), ("min", np.fmin, np.nan)):
                for w, grid in N.squares(laid.out(np.where(valid, x, none), none, rule), WINDOWS, rule).items():
                    made |= {f"_{f}s_{c}_{w}": v for c, v in zip(windows.extremes, laid.back(grid, mine))}
            for w, grid in N.squares(laid.out(valid, False, np.logical_or), WINDOWS, np.logical_or).items():
                known |= {f"{c}_range{w}": v for c, v in zip(windows.extremes, laid.back(grid, mine))}
        mine = t.filter(pa.array(own))
        with np.errstate(all="ignore"):
            features = windows.features({c: (value[c][own], t.column(c).is_valid().to_numpy()[own]) for c in windows.contrasts}, made, known)
        out = mine.select(list(keep))
        for n, (x, valid) in features.items():
            whole_number = x.dtype.kind == "i"
            out = out.append_column(n, pa.array(x if whole_number or digits is None else settled(x, digits), mask=None if valid is None else ~valid))
        return pa.Table.from_batches(out.combine_chunks().to_batches(max_chunksize=BATCH_ROWS), out.schema)

    return added


def feature_stack(dense: DataFrame, radii_m=N.RADII_M, digits: int | None = None) -> DataFrame:
    """All focal and disk predictors beside the base columns of the dense cell table, rounded to `digits` as results are, if named.

    Block-aware means, disks and border-free window statistics of a tile are added up in one task: the only shuffle moves the
    base columns of its cells and of the margin around them, never a sum.
    """
    values = list(dict.fromkeys([*BASES, *STD_BANDS, *MEAN_BANDS]))
    radii = [N.radius_px(m) for m in radii_m]
    disk_values = ["vegetation_cover", "ndvi", "ndbi"]
    flags = {**{f"_v_{v}": F.col(v).isNotNull() for v in disk_values}, **feature_flags()}
    dp = N.Packed(flags, N.disk_size(max(radii)))
    sp = N.Packed({v: F.col(v).isNotNull() for v in values}, max(WINDOWS) ** 2)
    sp_cols = {k.replace("_pk", "_sk"): x for k, x in sp.columns().items()}
    base = dense.columns
    reach, size = max(*radii, max(WINDOWS) // 2), N.TILE
    tile = ["year", "_tr", "_tc"]
    # A number of partitions is named, as few bytes that make much work would else be put together into few tasks.
    tasks = int(dense.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = N.tiled(dense, reach, size).repartition(tasks, *tile).withColumns({**dp.columns(), **sp_cols})
    free = list(dict.fromkeys([*STD_BANDS, *MEAN_BANDS]))
    whole = [*dp.columns(), *sp_cols]
    windows = _Windows([*disk_values, *dp.columns()], [*BASES, *sp_cols], [*free, *[f"_sq_{v}" for v in STD_BANDS], *sp_cols], RANGE_BANDS,
                       list(radii_m), dp.places(), {v: (p.replace("_pk", "_sk"), *at) for v, (p, *at) in sp.places().items()})
    schema = T.StructType([*[d.schema[c] for c in base], *[
        T.StructField(n, T.IntegerType() if n.startswith("landuse_dominant") else T.DoubleType()) for n in windows.feature_names()]])
    return d.groupBy(*tile).applyInArrow(_tile_features(base, whole, windows, size, digits), schema)
