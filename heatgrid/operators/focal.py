"""Focal statistics over squares and disks, by sums along rows and columns only.

A square is a window along the row, then one along the column. A disk is a stack of rows of
shrinking half-width; the rows of equal half-width are rectangles, so it is a sum of a few
"row window, then column window" pairs, all of one pass added up by `line_sums`. All columns and radii share one partitioning per pass:
two shuffles whatever is asked for. The grid must be dense (NULL cells kept as rows).

Where many windows are wanted at once (`features.feature_stack`), sums of lines would be more to move than cells: there cells
move, to square tiles with a margin, and all windows of a tile are added up in one task.

Counts of flags are small, so several travel in one long, each in its own bit field.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.operators.composite import run_starts

RADII_M = (50, 100, 250, 500)

#: Cells a side of a tile; with the margin that a disk of 17 cells needs, 1.4 times as many cells are moved as there are.
TILE = 192


def radius_px(radius_m: float, res_m: float = 30.0) -> int:
    return max(1, round(radius_m / res_m))


def half_widths(r: int) -> list[int]:
    """Half-width of the disk row at vertical offset 0..r."""
    return [math.isqrt(r * r - dy * dy) for dy in range(r + 1)]


def disk_size(r: int) -> int:
    h = half_widths(r)
    return 2 * sum(2 * x + 1 for x in h) - (2 * h[0] + 1)


def bands(r: int) -> list[tuple[int, int | None, int]]:
    """(half-width, next narrower half-width or None, half-height) of the disk's rectangles.

    Rows within the half-height are at least this wide, so each rectangle contributes the
    columns beyond the next narrower one and every disk cell is met once.
    """
    tall: dict[int, int] = {}
    for dy, hw in enumerate(half_widths(r)):
        tall[hw] = dy
    widths = sorted(tall)
    return [(hw, widths[i - 1] if i else None, tall[hw]) for i, hw in enumerate(widths)]


def spread(df: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """First pass partitioning; windows by (keys, row) or (keys, block, row) both fit in it."""
    return df.repartition(*keys, "row")


def over_row(agg: str, keys: Sequence[str], h: int) -> str:
    """Window aggregate over the columns within h, as SQL text: thousands are made per plan."""
    return f"{agg} over (partition by {', '.join(keys)}, row order by col range between {h} preceding and {h} following)"


def over_col(agg: str, keys: Sequence[str], h: int) -> str:
    return f"{agg} over (partition by {', '.join(keys)}, col order by row range between {h} preceding and {h} following)"


def named(exprs: dict[str, str]) -> list[str]:
    return [f"{x} as `{n}`" for n, x in exprs.items()]


def ratio(total: str, n: str) -> str:
    return f"try_divide({total}, nullif({n}, 0))"


class Packed:
    """Boolean columns as bit fields of a few longs."""

    def __init__(self, flags: dict[str, Column], most: int):
        self.bits = max(1, most.bit_length())
        per = 62 // self.bits
        names = list(flags)
        self.groups = [names[i:i + per] for i in range(0, len(names), per)]
        self.flags = flags

    def columns(self) -> dict[str, Column]:
        out = {}
        for g, names in enumerate(self.groups):
            c = F.lit(0).cast("long")
            for i, n in enumerate(names):
                c = c + F.when(self.flags[n], F.lit(1 << (self.bits * i))).otherwise(F.lit(0)).cast("long")
            out[f"_pk{g}"] = c
        return out

    def places(self) -> dict[str, tuple[str, int, int]]:
        """Flag name -> its packed column, its first bit and the mask of its bits."""
        mask = (1 << self.bits) - 1
        return {n: (f"_pk{g}", self.bits * i, mask) for g, names in enumerate(self.groups) for i, n in enumerate(names)}

    def unpack(self, at) -> dict[str, str]:
        """Flag name -> SQL of its count, where `at(packed column)` names the summed column."""
        return {n: f"(shiftright(`{at(p)}`, {shift}) & {mask}L)" for n, (p, shift, mask) in self.places().items()}


class Sums(NamedTuple):
    """Sum of (column, column to take away or None, half-width) over the cells of the same line, and of the same `within` if named."""

    terms: Sequence[tuple[str, str | None, int]]
    within: str | None = None


def _line_adder(line: Sequence[str], along: str, sums: Mapping[str, Sums], whole: Mapping[str, bool], kept: Sequence[str]) -> Callable:
    """Sums of whole lines from rows in order of line and place; an unfinished line waits for the next batch."""

    def added(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        n = len(t)
        number = np.repeat(np.arange(len(at), dtype=np.int64), np.diff(np.append(at, n)))
        place = t.column(along).to_numpy().astype(np.int64)
        names = {x for s in sums.values() for a, b, _ in s.terms for x in (a, b) if x}
        kind = {x: np.int64 if pa.types.is_integer(t.schema.field(x).type) else np.float64 for x in names}
        value = {x: t.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(kind[x]) for x in names}
        made = {}
        for scope in dict.fromkeys(s.within for s in sums.values()):
            group, order = number, None
            if scope is not None:
                code = t.column(scope).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                order = np.lexsort((place, code, number))
                new = np.ones(n, dtype=bool)
                new[1:] = (np.diff(number[order]) != 0) | (np.diff(code[order]) != 0)
                group = np.cumsum(new)
            x = place if order is None else place[order]
            reach = 2 * max(h for s in sums.values() for *_, h in s.terms) + 1
            key = group * (int(x.max() - x.min()) + reach + 1) + (x - x.min())
            frames = {}
            for out, s in sums.items():
                if s.within != scope:
                    continue
                total = None
                for a, b, h in s.terms:
                    if h not in frames:
                        ends = np.empty(2 * n, dtype=np.int64)
                        ends[::2], ends[1::2] = np.searchsorted(key, key - h, "left"), np.searchsorted(key, key + h, "right")
                        frames[h] = ends
                    v = value[a] if b is None else value[a] - value[b]
                    v = v if order is None else v[order]
                    part = np.add.reduceat(np.append(v, v.dtype.type(0)), frames[h])[::2]
                    total = part if total is None else total + part
                if order is not None:
                    back = np.empty_like(total)
                    back[order] = total
                    total = back
                made[out] = pa.array(total, pa.int64() if whole[out] else pa.float64())
        return pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in kept], *[made[o] for o in sums]], names=[*kept, *sums])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([*waiting, b])
            at = run_starts([t.column(k).combine_chunks() for k in line])
            if len(at) > 1:
                yield added(t.slice(0, int(at[-1])).combine_chunks(), at[:-1])
            waiting = t.slice(int(at[-1])).combine_chunks().to_batches()
        if waiting:
            yield added(pa.Table.from_batches(waiting).combine_chunks(), np.zeros(1, dtype=np.int64))

    return lines


def line_sums(df: DataFrame, line: Sequence[str], along: str, sums: Mapping[str, Sums], keep: Sequence[str]) -> DataFrame:
    """`keep` and long or double sums over the neighbours within a half-width on the same line, NULL counting as zero.

    `df` is partitioned by `line` or part of it. Each window is added up anew (no differences of running sums, whose rounding
    would show), a batch of lines at a time; a task holds one line and one batch.
    """
    small = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    whole = {o: isinstance(df.schema[s.terms[0][0]].dataType, small) for o, s in sums.items()}
    used = {x for s in sums.values() for a, b, _ in s.terms for x in (a, b) if x}
    d = df.withColumns({x: F.col(x).cast("double") for x in used if not isinstance(df.schema[x].dataType, (*small, T.DoubleType))})
    out = T.StructType([*[d.schema[c] for c in keep], *[T.StructField(o, T.LongType() if w else T.DoubleType()) for o, w in whole.items()]])
    return d.sortWithinPartitions(*line, along).mapInArrow(_line_adder(line, along, sums, whole, list(keep)), out)


def tiled(df: DataFrame, reach: int, size: int) -> DataFrame:
    """Every row once for each tile that holds it or lies within `reach` of it, with the tile's numbers `_tr` and `_tc`."""
    def tiles(x):
        return F.explode(F.sequence(F.floor((F.col(x) - reach) / size), F.floor((F.col(x) + reach) / size)))

    return df.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))


class Laid:
    """Rows of a tile laid out as a grid: values of one cell are added up (or combined by another rule), cells without rows hold `fill`."""

    def __init__(self, row: np.ndarray, col: np.ndarray):
        r, c = row - row.min(), col - col.min()
        self.shape = int(r.max()) + 1, int(c.max()) + 1
        self.at = r * self.shape[1] + c

    def out(self, values: np.ndarray, fill: float = 0, rule: np.ufunc = np.add) -> np.ndarray:
        """Columns by rows -> columns by grid."""
        grid = np.full((len(values), self.shape[0] * self.shape[1]), fill, dtype=values.dtype)
        for g, v in zip(grid, values):
            rule.at(g, self.at, v)
        return grid.reshape(len(values), *self.shape)

    def back(self, grid: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return grid.reshape(len(grid), -1)[:, self.at[rows]]


def widened(grid: np.ndarray, halves: Sequence[int], rule: np.ufunc = np.add, axis: int = -1) -> Iterator[tuple[int, np.ndarray]]:
    """Half-width and the sums within it along an axis, narrow ones first: each adds its outer cells to the one before. The array is used again."""
    total = grid.copy()
    a, t = np.moveaxis(grid, axis, -1), np.moveaxis(total, axis, -1)
    done = 0
    for h in sorted(halves):
        for d in range(done + 1, h + 1):
            rule(t[..., d:], a[..., :-d], out=t[..., d:])
            rule(t[..., :-d], a[..., d:], out=t[..., :-d])
        done = h
        yield h, total


def disks(grid: np.ndarray, radii: Sequence[int]) -> dict[int, np.ndarray]:
    """Sums over the disk of each radius around every cell of (columns, rows, cols)."""
    out = {r: np.zeros_like(grid) for r in radii}
    rows = [(r, dy, w) for r in radii for dy, w in enumerate(half_widths(r))]
    for h, s in widened(grid, {w for *_, w in rows}):
        for r, dy, w in rows:
            if w == h and dy == 0:
                out[r] += s
            elif w == h:
                out[r][:, dy:] += s[:, :-dy]
                out[r][:, :-dy] += s[:, dy:]
    return out


def squares(grid: np.ndarray, widths: Sequence[int], rule: np.ufunc = np.add) -> dict[int, np.ndarray]:
    """Sums (or extremes) over the square of each odd width around every cell of (columns, rows, cols)."""
    return {2 * h + 1: next(widened(s, [h], rule, axis=1))[1] for h, s in widened(grid, [w // 2 for w in widths], rule)}


def disk_rows(cols: Sequence[str], widths: Sequence[int], within: str | None) -> dict[str, Sums]:
    """First pass of the disks: sums over each needed half-width along the row."""
    return {f"_h_{c}_{w}": Sums([(c, None, w)], within) for w in widths for c in cols}


def disk_cols(cols: Sequence[str], radii: Sequence[int], within: str | None) -> dict[str, Sums]:
    """Second pass: the disk's rectangles stacked along the column."""
    return {f"_d_{c}_{r}": Sums([(f"_h_{c}_{w}", None if narrower is None else f"_h_{c}_{narrower}", tall) for w, narrower, tall in bands(r)], within)
            for r in radii for c in cols}


def disk_widths(radii: Sequence[int]) -> list[int]:
    return sorted({w for r in radii for w, _, _ in bands(r)})


def disk_sums(
    df: DataFrame,
    values: Sequence[str],
    flags: dict[str, Column],
    radii: Sequence[int],
    keys: Sequence[str] = ("year", "block_id"),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `{v}_s{r}` (sum), `{v}_c{r}` (valid count) and `{flag}_n{r}` for every radius in px.

    With `keep`, only those columns, the keys and the place travel along.
    """
    counted = {**{f"_v_{v}": F.col(v).isNotNull() for v in values}, **flags}
    pack = Packed(counted, disk_size(max(radii)))
    cols = [*values, *pack.columns()]
    kept = df.columns if keep is None else list(dict.fromkeys([*keys, "row", "col", *keep]))
    d = df.withColumns(pack.columns()).select(*dict.fromkeys([*kept, *cols])).repartition(*keys, "row")
    d = line_sums(d, [*keys, "row"], "col", disk_rows(cols, disk_widths(radii), None), kept)
    d = line_sums(d.repartition(*keys, "col"), [*keys, "col"], "row", disk_cols(cols, radii, None), kept)
    out = {}
    for r in radii:
        un = pack.unpack(lambda p, r=r: f"_d_{p}_{r}")
        for v in values:
            out[f"{v}_s{r}"] = f"`_d_{v}_{r}`"
            out[f"{v}_c{r}"] = un[f"_v_{v}"]
        for n in flags:
            out[f"{n}_n{r}"] = un[n]
    return d.selectExpr(*kept, *named(out))


def disk_mean(v: str, r: int) -> Column:
    return F.try_divide(F.col(f"{v}_s{r}"), F.nullif(F.col(f"{v}_c{r}"), F.lit(0)))


def square_sums(
    df: DataFrame, values: Sequence[str], widths: Sequence[int], keys: Sequence[str], tag: str = "q"
) -> DataFrame:
    """Adds `{v}_{tag}s{w}` (sum) and `{v}_{tag}c{w}` (valid count) over w x w squares."""
    pack = Packed({v: F.col(v).isNotNull() for v in values}, max(widths) ** 2)
    cols = [*values, *pack.columns()]
    d = df.withColumns(pack.columns())
    d = d.selectExpr("*", *named({
        f"_h_{c}_{w}": f"coalesce({over_row(f'sum(`{c}`)', keys, w // 2)}, 0)" for w in widths for c in cols}))
    d = d.selectExpr(*df.columns, *named({
        f"_d_{c}_{w}": over_col(f"sum(`_h_{c}_{w}`)", keys, w // 2) for w in widths for c in cols}))
    out = {}
    for w in widths:
        un = pack.unpack(lambda p, w=w: f"_d_{p}_{w}")
        for v in values:
            out[f"{v}_{tag}s{w}"] = f"`_d_{v}_{w}`"
            out[f"{v}_{tag}c{w}"] = un[v]
    return d.selectExpr(*df.columns, *named(out))


def spread_std(mean: str, square: str) -> str:
    """Population deviation from the mean and the mean square, no less than zero."""
    return f"case when {mean} is not null then sqrt(greatest({square} - {mean} * {mean}, 0D)) end"


def focal_mean(df: DataFrame, values: Sequence[str], widths: Sequence[int] = (3, 5, 11),
               keys: Sequence[str] = ("year", "block_id")) -> DataFrame:
    """Adds `{v}_mean{w}`: mean of the valid cells of the square that lie in the same block."""
    d = square_sums(df, values, widths, keys)
    return d.selectExpr(*df.columns, *named({
        f"{v}_mean{w}": ratio(f"{v}_qs{w}", f"{v}_qc{w}") for v in values for w in widths}))


def focal_stats(
    df: DataFrame, mean: Sequence[str] = (), std: Sequence[str] = (), spread_of: Sequence[str] = (),
    widths: Sequence[int] = (3, 5, 11), keys: Sequence[str] = ("year",),
) -> DataFrame:
    """Adds `{v}_mean{w}`, `{v}_std{w}` (population) and `{v}_range{w}`, across block borders."""
    used = list(dict.fromkeys([*mean, *std]))
    d = df.withColumns({f"_sq_{v}": F.col(v) * F.col(v) for v in std})
    d = square_sums(d, [*used, *[f"_sq_{v}" for v in std]], widths, keys) if used else d
    if spread_of:
        d = d.selectExpr("*", *named({
            f"_{f}_{v}_{w}": over_row(f"{f}({v})", keys, w // 2) for v in spread_of for w in widths for f in ("min", "max")}))
        d = d.selectExpr("*", *named({
            f"{v}_range{w}": f"{over_col(f'max(_max_{v}_{w})', keys, w // 2)} - {over_col(f'min(_min_{v}_{w})', keys, w // 2)}"
            for v in spread_of for w in widths}))
    out = {}
    for w in widths:
        out |= {f"{v}_mean{w}": ratio(f"{v}_qs{w}", f"{v}_qc{w}") for v in mean}
        out |= {f"{v}_std{w}": spread_std(ratio(f"{v}_qs{w}", f"{v}_qc{w}"), ratio(f"_sq_{v}_qs{w}", f"_sq_{v}_qc{w}")) for v in std}
        out |= {f"{v}_range{w}": f"{v}_range{w}" for v in spread_of}
    return d.selectExpr(*df.columns, *named(out))


def class_boundary(df: DataFrame, label: str, keys: Sequence[str] = ("year",), out: str = "boundary") -> DataFrame:
    """True where an adjacent valid 4-neighbour has another class. Works on sparse cells."""
    across = W.partitionBy(*keys, "row").orderBy("col")
    along = W.partitionBy(*keys, "col").orderBy("row")

    def differs(w, x, f, step):
        return (f(x).over(w) == F.col(x) + step) & (f(label).over(w) != F.col(label))

    tests = [differs(across, "col", F.lag, -1), differs(across, "col", F.lead, 1)]
    d = df.withColumn("_x", F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)))
    tests = [differs(along, "row", F.lag, -1), differs(along, "row", F.lead, 1)]
    y = F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False))
    return d.withColumn(out, F.col("_x") | y).drop("_x")


def adjacent_gradient(df: DataFrame, value: str, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Largest absolute step of `value` between row-adjacent cells, per key."""
    w = W.partitionBy(*keys, "row").orderBy("col")
    step = F.when(F.col("col") - F.lag("col").over(w) == 1, F.abs(F.col(value) - F.lag(value).over(w)))
    return df.withColumn("_g", step).groupBy(*keys).agg(
        F.max("_g").alias("max_gradient"), F.count("_g").alias("n_pairs")
    )
