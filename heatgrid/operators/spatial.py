"""Grids, distance fields, resampling, rasterising and nearest neighbours as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.session import cut

PIXEL_M = 30.0
TILE_BITS = 2  # tiles of 4 x 4, then 4 x 4 of those
IDW_COS_LAT, IDW_EPS = 28.64, 1e-6
FIRST_COL, LAST_COL = -2**31, 2**31 - 1


def lattice(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Every (row, col) of the grid, made by Spark in parallel."""
    return spark.range(height * width).select(
        F.expr(f"cast(id div {width} as int)").alias("row"),
        (F.col("id") % width).cast("int").alias("col"),
    )


def densify(cells: DataFrame, grid: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Every key on every grid cell, NULL where nothing is stored.

    The key table (years) is a handful of rows: each grid row takes it along as an array.
    """
    years = cells.select(*keys).distinct().agg(F.collect_set(F.struct(*keys)).alias("_ks"))
    full = (
        grid.join(F.broadcast(years)).select(grid["*"], F.explode("_ks").alias("_k"))
        .select("_k.*", *[grid[c] for c in grid.columns])
    )
    return full.join(cells, [*keys, "row", "col"], "left")


def fill_nodata(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


# --- exact distance transform ---------------------------------------------------------------

def _along_columns(features: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, f): on each grid row in use and each column with features, the nearest feature row f of the column.

    A feature answers for the rows nearer to it than to its neighbours in the column; halfway the upper one does.
    `ends` has one row per key: without keys it is one row, which Spark joins by a nested loop.
    """
    column = W.partitionBy(*keys, "col").orderBy("f")
    before, after = F.lag("f").over(column), F.lead("f").over(column)
    ends = lines.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("row").alias("_top"), F.max("row").alias("_end"))
    own = (
        features.select(*keys, "col", F.col("row").alias("f")).distinct()
        .withColumns({"_from": F.floor((before + F.col("f")) / 2).cast("int") + 1, "_to": F.floor((F.col("f") + after) / 2).cast("int")})
        .join(ends, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
        .withColumns({"_from": F.greatest("_from", "_top"), "_to": F.least("_to", "_end")}).where("_from <= _to"))
    spread = own.select(*keys, F.explode(F.sequence("_from", "_to")).alias("row"), "col", "f")
    used = lines.select([F.col(x).alias(f"_{x}") for x in [*keys, "row"]])
    return spread.join(used, reduce(and_, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in [*keys, "row"]]), "left_semi")


def _lower_envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries (keys, row, col, f, first) in order of grid row and column: who is nearest, from which column on.

    Entry j passes an earlier entry i at one column and stays ahead, so a stack of owners suffices: linear in the
    entries. The stack of an unfinished grid row is carried from batch to batch; whole numbers only.
    """
    stack: list[tuple] = []
    schema = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    for b in batches:
        kinds = b.schema
        n = len(kinds) - 3  # keys and row
        schema = pa.schema([*[kinds.field(i) for i in range(n)], pa.field("start", pa.int32()),
                            pa.field("f_row", pa.int32()), pa.field("f_col", pa.int32())])
        done: list[tuple] = []
        for *line, col, f, first in zip(*[x.to_pylist() for x in b.columns]):
            if first:
                done += stack
                stack = []
            height, start = (line[-1] - f) ** 2 + col * col, FIRST_COL
            while stack:
                *_, held, up, left = stack[-1]
                lead, gap = height - (line[-1] - up) ** 2 - left * left, 2 * (col - left)
                # equal distance: the smaller feature row, then the smaller column
                start = -(-lead // gap) + (lead % gap == 0 and up <= f)
                if start > held:
                    break
                stack.pop()
                start = FIRST_COL
            if start <= LAST_COL:
                stack.append((*line, start, f, col))
        if done:
            yield batch(done)
    if stack:
        yield batch(stack)


def nearest_of(cells: DataFrame, features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds (d2, f_row, f_col) of the nearest of `features` (keys, row, col) to every cell; ties: least row, then column.

    Exact on any set of cells, dense or not; NULL where the key has no feature. Features are spread along their columns,
    each grid row is swept once for the columns where the nearest one changes, and cells look up the change before them.
    Only keys, rows and columns reach Python; cells move once, in a window over their own grid row.
    """
    ks = [*keys, "_g"]
    cells, features = cells.withColumn("_g", F.lit(1)), features.withColumn("_g", F.lit(1))
    lines = cells.select(*ks, "row").distinct()
    entries = _along_columns(features.select(*ks, "row", "col"), lines, ks)
    sweep = W.partitionBy(*ks, "row").orderBy("col")
    entries = entries.select(*ks, "row", "col", "f", (F.row_number().over(sweep) == 1).alias("first"))
    types = {x.name: x.dataType for x in entries.schema.fields}
    out = T.StructType([T.StructField(x, types[x]) for x in [*ks, "row"]] + [T.StructField(x, T.IntegerType()) for x in ("start", "f_row", "f_col")])
    starts = entries.mapInArrow(_lower_envelopes, out)
    starts = starts.select(*ks, "row", F.col("start").alias("col"), F.struct("f_row", "f_col").alias("_f"), F.lit(0).alias("_cell"))
    both = starts.unionByName(cells.withColumn("_cell", F.lit(1)), allowMissingColumns=True)
    upto = W.partitionBy(*ks, "row").orderBy("col", "_cell").rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_f", F.last("_f", ignorenulls=True).over(upto)).where("_cell = 1")
    down, across = (F.col("row") - F.col("_f.f_row")).cast("double"), (F.col("col") - F.col("_f.f_col")).cast("double")
    plain = [x for x in cells.columns if x != "_g"]
    return near.select(*plain, (down * down + across * across).alias("d2"), "_f.f_row", "_f.f_col")


def facing(cells: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The features (keys, row, col) that `nearest_of` can give to `cells`, which may be far fewer.

    Beside the columns that a key's cells lie in, only the first feature of each grid row counts: those behind it are
    farther from every cell. Keys are few (years and folds) and not NULL, so their column ranges are broadcast.
    """
    keys = list(keys)
    span = cells.groupBy(*keys).agg(F.min("col").alias("_lo"), F.max("col").alias("_hi"))
    at = features.join(F.broadcast(span), keys)
    left, right = F.col("col") <= F.col("_lo"), F.col("col") >= F.col("_hi")
    first = at.where(left | right).groupBy(*keys, "row").agg(
        F.max(F.when(left, F.col("col"))).alias("_l"), F.min(F.when(right, F.col("col"))).alias("_r"))
    first = first.select(*keys, "row", F.explode(F.array("_l", "_r")).alias("col")).where(F.col("col").isNotNull())
    return at.where(~(left | right)).select(*keys, "row", "col").unionByName(first)


def nearest_feature(df: DataFrame, on: Column, keys: Sequence[str] = ()) -> DataFrame:
    """`nearest_of` with those cells as features where `on`."""
    return nearest_of(df, df.where(on).select(*keys, "row", "col"), keys)


def distance_to(cells: DataFrame, features: DataFrame, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Euclidean pixel distance times the pixel size, 0 on a feature."""
    return nearest_of(cells, features, keys).withColumn(out, F.sqrt("d2") * PIXEL_M).drop("d2", "f_row", "f_col")


def distance_to_feature(df: DataFrame, on: Column, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """`distance_to` with those cells as features where `on`."""
    return distance_to(df, df.where(on).select(*keys, "row", "col"), out, keys)


def gap_fill_nearest(df: DataFrame, label: str, keys: Sequence[str] = ("year",)) -> DataFrame:
    """A NULL label takes the nearest stored one (least distance, then row, then col); stored ones have distance 0."""
    known = df.where(F.col(label).isNotNull())
    src = known.select(*keys, F.col("row").alias("f_row"), F.col("col").alias("f_col"), F.col(label).alias("_label"))
    gaps = nearest_of(df.where(F.col(label).isNull()).drop(label), known.select(*keys, "row", "col"), keys)
    filled = gaps.join(src, [*keys, "f_row", "f_col"], "left").withColumn(label, F.col("_label")).select(*df.columns, "d2")
    return filled.unionByName(known.withColumn("d2", F.lit(0.0)))


# --- resampling ---------------------------------------------------------------------------

def _overlap(df: DataFrame, axis: str, ratio: float, shift: float) -> DataFrame:
    """Explode a source axis to the destination indices it touches, with overlap weights."""
    lo = (F.col(axis) + F.lit(shift)) * F.lit(ratio)
    hi = (F.col(axis) + F.lit(shift) + 1) * F.lit(ratio)
    return (
        df.withColumn("_lo", lo).withColumn("_hi", hi)
        .withColumn(f"d_{axis}", F.explode(F.sequence(
            F.floor("_lo").cast("int"), (F.ceil("_hi") - 1).cast("int"))))
        .withColumn(f"w_{axis}", F.least(F.col("_hi"), F.col(f"d_{axis}") + 1)
                    - F.greatest(F.col("_lo"), F.col(f"d_{axis}").cast("double")))
        .drop("_lo", "_hi")
    )


def overlap_pairs(src: DataFrame, ratio: float, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Source pixels beside each destination pixel they overlap (d_row, d_col, w).

    `ratio` is source size over destination size, `shift` the source origin in source pixels.
    A source pixel touches a fixed few destination pixels, so this is an equi job, not a range join.
    """
    d = _overlap(_overlap(src, "row", ratio, shift[0]), "col", ratio, shift[1])
    return d.withColumn("w", F.col("w_row") * F.col("w_col")).drop("w_row", "w_col")


def resample_average(
    src: DataFrame, value: str, ratio: float, shift: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("year",)
) -> DataFrame:
    """Overlap-weighted mean of the valid source pixels; NULL below a trace of weight."""
    w = F.when(F.col(value).isNotNull(), F.col("w")).otherwise(0.0)
    return (
        overlap_pairs(src, ratio, shift)
        .groupBy(*keys, F.col("d_row").alias("row"), F.col("d_col").alias("col"))
        .agg(F.sum(F.col(value) * F.col("w")).alias("_vw"), F.sum(w).alias("_w"))
        .select(*keys, "row", "col", F.when(F.col("_w") > 1e-6, F.col("_vw") / F.col("_w")).alias(value))
    )


def resample_valid(
    src: DataFrame, valid: Column, ratio: float, shift: tuple[float, float] = (0.0, 0.0), keys: Sequence[str] = ("year",)
) -> DataFrame:
    return (
        overlap_pairs(src.withColumn("_ok", valid), ratio, shift).where(F.col("w") > 1e-6)
        .groupBy(*keys, F.col("d_row").alias("row"), F.col("d_col").alias("col"))
        .agg(F.bool_or("_ok").alias("valid"))
    )


def resample_nearest(src: DataFrame, grid: DataFrame, ratio: float, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Each destination centre takes the source pixel it falls in (shift 0)."""
    def at(x):
        return F.floor((F.col(x) + 0.5) / F.lit(ratio)).cast("int")

    look = grid.select("row", "col", at("row").alias("s_row"), at("col").alias("s_col"))
    s = src.withColumnsRenamed({"row": "s_row", "col": "s_col"})
    return s.join(look, ["s_row", "s_col"]).drop("s_row", "s_col")


# --- polygons ------------------------------------------------------------------------------

def ring_edges(vertices: DataFrame, keys: Sequence[str] = ("feature", "ring")) -> DataFrame:
    """(x1, y1) -> (x2, y2) along each ring in `pos` order; the ring repeats its first vertex."""
    w = W.partitionBy(*keys).orderBy("pos")
    return (
        vertices.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
        .where(F.col("x2").isNotNull()).withColumnsRenamed({"x": "x1", "y": "y1"})
    )


def rasterize_spans(edges: DataFrame, height: int, width: int) -> DataFrame:
    """(feature, row, c_lo, c_hi): scan-line spans of cell centres inside by the even-odd rule."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.ceil(lo - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(hi - 0.5) - 1, F.lit(height - 1)).cast("int")
    cy = F.col("row") + 0.5
    cross = (
        edges.withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
        .withColumn("row", F.explode(F.sequence("_a", "_b")))
        .withColumn("xc", F.col("x1") + (cy - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    w = W.partitionBy("feature", "row").orderBy("xc")
    spans = (
        cross.withColumn("_k", F.row_number().over(w)).withColumn("xe", F.lead("xc").over(w))
        .where("_k % 2 = 1 and xe is not null")
    )
    return spans.select(
        "feature", "row",
        F.greatest(F.ceil(F.col("xc") - 0.5), F.lit(0)).cast("int").alias("c_lo"),
        F.least(F.ceil(F.col("xe") - 0.5) - 1, F.lit(width - 1)).cast("int").alias("c_hi"),
    ).where("c_lo <= c_hi")


def rasterize_centre(edges: DataFrame, values: DataFrame, height: int, width: int) -> DataFrame:
    """Cells whose centre is inside a feature; where features overlap the later one wins."""
    inside = rasterize_spans(edges, height, width).select(
        "feature", "row", F.explode(F.sequence("c_lo", "c_hi")).alias("col")
    )
    return (
        inside.join(values, "feature").groupBy("row", "col")
        .agg(F.max_by("value", "feature").alias("value"))
    )


def rasterize_touched(edges: DataFrame, height: int, width: int) -> DataFrame:
    """Cells that any edge touches or whose centre is inside."""
    x0, x1 = F.least("x1", "x2"), F.greatest("x1", "x2")
    y0, y1 = F.least("y1", "y2"), F.greatest("y1", "y2")

    def span(lo, hi, n):
        return F.sequence(
            F.greatest(F.ceil(lo) - 1, F.lit(0)).cast("int"), F.least(F.floor(hi), F.lit(n - 1)).cast("int")
        )

    on_grid = (x1 >= 0) & (y1 >= 0) & (x0 <= width) & (y0 <= height)
    near = (
        edges.where(on_grid).withColumn("row", F.explode(span(y0, y1, height)))
        .withColumn("col", F.explode(span(x0, x1, width)))
    )
    # A box is cut by the line when its corners are not all strictly on one side.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = [
        dy * (F.col("col") + i - F.col("x1")) - dx * (F.col("row") + j - F.col("y1"))
        for i in (0, 1) for j in (0, 1)
    ]
    cut_ = near.where((F.least(*side) <= 0) & (F.greatest(*side) >= 0)).select("row", "col")
    inside = rasterize_spans(edges, height, width).select(
        "row", F.explode(F.sequence("c_lo", "c_hi")).alias("col")
    )
    return cut_.union(inside).distinct()


def polygon_area_km2(vertices: DataFrame) -> DataFrame:
    """Shoelace area of lon/lat rings less the holes, with degrees scaled at the mean latitude."""
    e = ring_edges(vertices, ["feature", "ring"])
    ring = e.groupBy("feature", "ring").agg(
        F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"),
        F.avg("y1").alias("lat"),
    )
    km = F.col("a") * 111.32 * 111.32 * F.cos(F.radians("lat"))
    return ring.groupBy("feature").agg(
        F.sum(F.when(F.col("ring") == 0, km).otherwise(-km)).alias("area_km2"),
        F.count(F.lit(1)).alias("n_rings"),
    )


def clip_bbox(features: DataFrame, bbox: tuple[float, float, float, float], pad: float = 0.01) -> DataFrame:
    """Marks features whose box meets the padded (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bbox
    keep = (
        (F.col("max_x") >= x0 - pad) & (F.col("min_x") <= x1 + pad)
        & (F.col("max_y") >= y0 - pad) & (F.col("min_y") <= y1 + pad)
    )
    return features.withColumn("kept", keep)


# --- area ----------------------------------------------------------------------------------

def utm_expr(lat: str, lon: str, lon0: float = 75.0) -> tuple[str, str]:
    """(easting, northing) of the transverse Mercator series, as SQL text over two columns."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    p, l_ = f"radians({lat})", f"radians({lon} - {lon0})"
    n = f"({a} / sqrt(1 - {e2!r} * power(sin({p}), 2)))"
    t, c = f"power(tan({p}), 2)", f"({ep2!r} * power(cos({p}), 2))"
    aa = f"({l_} * cos({p}))"
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    m2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    m4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    m6 = 35 * e2**3 / 3072
    m = f"({a} * ({m0!r} * {p} - {m2!r} * sin(2 * {p}) + {m4!r} * sin(4 * {p}) - {m6!r} * sin(6 * {p})))"
    east = (f"({k0} * {n} * ({aa} + (1 - {t} + {c}) * power({aa}, 3) / 6"
            f" + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {ep2!r}) * power({aa}, 5) / 120) + 500000)")
    north = (f"({k0} * ({m} + {n} * tan({p}) * (power({aa}, 2) / 2"
             f" + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * power({aa}, 4) / 24"
             f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {ep2!r}) * power({aa}, 6) / 720)))")
    return east, north


def cell_area_m2(cells: DataFrame, origin_x: float, origin_y: float, res: float) -> DataFrame:
    """Projected area of each cell from its four corners."""
    d = cells
    corners = [(0, 0), (0, 1), (1, 1), (1, 0)]
    for i, (dr, dc) in enumerate(corners):
        lat, lon = f"({origin_y!r} - (row + {dr}) * {res!r})", f"({origin_x!r} + (col + {dc}) * {res!r})"
        e, n = utm_expr(lat, lon)
        d = d.withColumn(f"_e{i}", F.expr(e)).withColumn(f"_n{i}", F.expr(n))
    # Shoelace relative to the first corner, whose large coordinates would cost digits.
    e = [F.col(f"_e{i}") - F.col("_e0") for i in range(4)]
    n = [F.col(f"_n{i}") - F.col("_n0") for i in range(4)]
    twice = e[1] * n[2] - e[2] * n[1] + e[2] * n[3] - e[3] * n[2]
    return d.withColumn("area_m2", F.abs(twice) / 2).select(*cells.columns, "area_m2")


# --- inverse distance, nearest neighbours ----------------------------------------------------

#: Stations carried in one array; a larger network travels as several arrays whose sums are merged.
ARRAY_POINTS = 512


def idw(
    cells: DataFrame, points: DataFrame, names: Sequence[str], by: Sequence[str] = ("year",), array_points: int = ARRAY_POINTS
) -> DataFrame:
    """sum(w v) / sum(w), w = 1/(dlat^2 + (cos(lat0) dlon)^2 + eps), over a year's stations whose v is not null.

    One row per row of `cells`, repeated rows included; NULL where no station has a value. Stations travel
    with each cell as arrays, so cells are neither paired with stations nor shuffled. Only when a year has more
    than `array_points` stations is a cell met once per array, and the sums of its arrays are added.
    """
    by = list(by)
    cosl = math.cos(math.radians(IDW_COS_LAT))
    most = points.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // array_points))
    packed = points.groupBy(*by, F.pmod(F.hash("point_id", "lat", "lon"), F.lit(parts)).alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("point_id", "lat", "lon", *names))).alias("_pts")
    ).drop("_part")

    def weight(p):
        dlat, dlon = F.col("lat") - p["lat"], (F.col("lon") - p["lon"]) * cosl
        return 1.0 / (dlat * dlat + dlon * dlon + IDW_EPS)

    def added(terms):
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    keys = cells.columns
    if parts > 1:  # repeated rows are settled once
        cells = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    stations = F.broadcast(packed) if parts == 1 else packed
    d = cells.join(stations, by).withColumn("_w", F.transform("_pts", weight))
    for i, n in enumerate(names):
        d = d.withColumn(f"_v{i}", added(F.zip_with("_pts", "_w", lambda p, w: p[n] * w)))
        d = d.withColumn(f"_t{i}", added(F.zip_with("_pts", "_w", lambda p, w: F.when(p[n].isNotNull(), w))))
    if parts > 1:
        sums = [F.sum(f"_{x}{i}").alias(f"_{x}{i}") for x in "vt" for i in range(len(names))]
        d = d.groupBy(*keys, "_times").agg(*sums).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return d.select(*keys, *[F.try_divide(f"_v{i}", f"_t{i}").alias(n) for i, n in enumerate(names)])


def knn(points: DataFrame, k: int = 8, keys: Sequence[str] = ("year",), start: int = 2) -> DataFrame:
    """k nearest other points of each grid point (distance, then row, then col), exactly.

    Where points are dense, the offsets within radius `start` settle a point: if at least k points
    lie in that disk, the k nearest are among them. The others go through tiles (`tile_frontiers`),
    so a far point costs rows in proportion to the tiles it looks at, not to the area around it.
    Points of groups of k or fewer get all others. Rows with a null key, row or col have no neighbours.
    """
    keys = list(keys)
    me = [*keys, "row", "col"]
    pts = points.select(*me).distinct()
    out = [*me, "k", "n_row", "n_col", "d2"]
    w = W.partitionBy(*me).orderBy("d2", "n_row", "n_col")
    span = F.sequence(F.lit(-start), F.lit(start))
    near = cut(
        pts.withColumn("_dr", F.explode(span)).withColumn("_dc", F.explode(span))
        .withColumn("d2", F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc"))
        .where((F.col("d2") > 0) & (F.col("d2") <= start * start))
        .withColumn("n_row", F.col("row") + F.col("_dr")).withColumn("n_col", F.col("col") + F.col("_dc")).drop("_dr", "_dc")
        .join(pts.withColumnsRenamed({"row": "n_row", "col": "n_col"}), [*keys, "n_row", "n_col"])
        .withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(*out)
    )
    full = near.where(F.col("k") == k).select(*me)
    done = near.join(full, me, "left_semi")
    todo = cut(pts.join(full, me, "left_anti"))
    if todo.isEmpty():
        return done
    last = tile_frontiers(todo, pts, k, keys)[-1]
    inside = pts.select(
        *keys, F.col("row").alias("n_row"), F.col("col").alias("n_col"),
        F.shiftright("row", TILE_BITS).alias("_tr"), F.shiftright("col", TILE_BITS).alias("_tc"))
    dr, dc = F.col("n_row") - F.col("row"), F.col("n_col") - F.col("col")
    far = (
        last.join(inside, [*keys, "_tr", "_tc"]).withColumn("d2", dr * dr + dc * dc).where(F.col("d2") > 0)
        .withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(*out)
    )
    return done.unionByName(far)


def tile_frontiers(todo: DataFrame, pts: DataFrame, k: int, keys: Sequence[str]) -> list[DataFrame]:
    """Tiles that may hold one of the k nearest points of each row of `todo`, from coarse to fine.

    Level l has square tiles of side 4^l with their number of points. Upwards, a point takes the first
    level at which its 3 x 3 tiles hold k others, so its k nearest lie within 7 x 7 tiles of that level.
    Downwards, those tiles are split again and again; the distance that surely covers k points (farthest
    corners, nearest tiles first) drops every tile whose nearest corner lies beyond it. A tile of a level
    holds at most 16 k points that are still looking there: no join key grows with the data. Points whose
    whole group has k others or fewer keep all tiles.
    """
    keys = list(keys)
    me = [*keys, "row", "col"]
    ends = pts.agg(F.max("row") - F.min("row"), F.max("col") - F.min("col")).first()
    extent = max(ends[0] or 0, ends[1] or 0) + 1
    tile = [*keys, "_tr", "_tc"]

    def around(d, level, reach):
        span = F.sequence(F.lit(-reach), F.lit(reach))
        return (
            d.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
            .select(*me, (F.shiftright("row", TILE_BITS * level) + F.col("_i")).alias("_tr"),
                    (F.shiftright("col", TILE_BITS * level) + F.col("_j")).alias("_tc"))
            .join(nodes[level], tile)
        )

    nodes = {1: cut(
        pts.groupBy(*keys, F.shiftright("row", TILE_BITS).alias("_tr"), F.shiftright("col", TILE_BITS).alias("_tc"))
        .agg(F.count(F.lit(1)).alias("_n")))}
    entry, level, looking = {}, 0, todo.select(*me)
    while True:
        level += 1
        if level > 1:
            nodes[level] = cut(
                nodes[level - 1].groupBy(*keys, F.shiftright("_tr", TILE_BITS).alias("_tr"), F.shiftright("_tc", TILE_BITS).alias("_tc"))
                .agg(F.sum("_n").alias("_n")))
        if 1 << (TILE_BITS * level) > extent:
            entry[level] = looking
            break
        seen = cut(around(looking, level, 1).groupBy(*me).agg((F.sum("_n") - 1).alias("_seen")))
        entry[level] = seen.where(F.col("_seen") >= k).select(*me)
        looking = seen.where(F.col("_seen") < k).select(*me)
        if looking.isEmpty():
            break

    def gap(x, t, side):
        low = F.col(t).cast("long") * side
        high, at = low + (side - 1), F.col(x).cast("long")
        return F.greatest(low - at, at - high, F.lit(0).cast("long")), F.greatest(F.abs(at - low), F.abs(at - high))

    fronts: list[DataFrame] = []
    for at in range(level, 0, -1):
        cand = around(entry[at], at, 3)
        if fronts:
            parent = fronts[-1].withColumnsRenamed({"_tr": "_pr", "_tc": "_pc"})
            child = nodes[at].withColumn("_pr", F.shiftright("_tr", TILE_BITS)).withColumn("_pc", F.shiftright("_tc", TILE_BITS))
            cand = cand.unionByName(parent.join(child, [*keys, "_pr", "_pc"]).select(*me, "_tr", "_tc", "_n"))
        side = 1 << (TILE_BITS * at)
        (r0, r1), (c0, c1) = gap("row", "_tr", side), gap("col", "_tc", side)
        own = (r0 == 0) & (c0 == 0)
        sofar = W.partitionBy(*me).orderBy("_far", "_tr", "_tc").rowsBetween(W.unboundedPreceding, W.currentRow)
        fronts.append(cut(
            cand.select(*me, "_tr", "_tc", (r0 * r0 + c0 * c0).alias("_near"), (r1 * r1 + c1 * c1).alias("_far"),
                        (F.col("_n") - own.cast("long")).alias("_n"))
            .withColumn("_sum", F.sum("_n").over(sofar))
            .withColumn("_bound", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(W.partitionBy(*me)))
            .where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound"))).select(*me, "_tr", "_tc")))
    return fronts
