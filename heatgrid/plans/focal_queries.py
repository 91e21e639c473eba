"""Focal statistics, checked against a brute-force self-join on the dense grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.operators import features as E
from heatgrid.operators import focal as N
from heatgrid.operators import spatial as SP
from heatgrid.plans import views as V
from heatgrid.plans.join_queries import MET_OUT, with_weather
from heatgrid.plans.registry import finish, query

c = F.col


def grid_cells(spark, sf):
    """Dense cells with the static layers: what the feature stack reads."""
    cells = V.cells(spark, sf).drop("block_id", "in_study", "clear_count")
    return SP.densify(cells, V.cells_static(spark, sf))


_JOIN = """FROM g a JOIN g b ON a.year = b.year {block} AND b.row BETWEEN a.row - {h} AND a.row + {h}
  AND b.col BETWEEN a.col - {h} AND a.col + {h}"""
_G = """g AS (SELECT d.*, s.landuse_class, s.dist_road_m, s.dist_vegetation_m, s.dist_building_m
  FROM dense d JOIN cells_static s ON d.row = s.row AND d.col = s.col)"""
_BLOCK = "AND a.block_id = b.block_id"


def _avg(v, w):
    h = w // 2
    f = f"FILTER (WHERE abs(a.row - b.row) <= {h} AND abs(a.col - b.col) <= {h})"
    return f"round(avg(b.{v}) {f}, 6) + 0 AS {v}_mean{w}"


@query("nbr1_focal_mean", f"""
WITH {_G} SELECT a.year, a.row, a.col, {', '.join(_avg(v, w) for v in ('ndvi', 'ndbi', 'dist_road_m') for w in (3, 5, 11))}
{_JOIN.format(block=_BLOCK, h=5)} GROUP BY a.year, a.row, a.col""", "dense cells_static")
def _(spark, sf):
    d = N.focal_mean(N.spread(grid_cells(spark, sf)), ["ndvi", "ndbi", "dist_road_m"])
    return d.select("year", "row", "col", *[f"{v}_mean{w}" for v in ("ndvi", "ndbi", "dist_road_m") for w in (3, 5, 11)])


def _stat(w):
    h = w // 2
    f = f"FILTER (WHERE abs(a.row - b.row) <= {h} AND abs(a.col - b.col) <= {h})"
    return (f"round(avg(b.ndre) {f}, 4) + 0 AS ndre_mean{w}, round(stddev_pop(b.ndvi) {f}, 4) AS ndvi_std{w}, "
            f"round(max(b.ndbi) {f} - min(b.ndbi) {f}, 4) + 0 AS ndbi_range{w}")


@query("nbr2_focal_stats", f"""
SELECT a.year, a.row, a.col, {', '.join(_stat(w) for w in (3, 5, 11))}
{_JOIN.format(block='', h=5).replace('g a', 'dense a').replace('g b', 'dense b')} GROUP BY a.year, a.row, a.col""",
       "dense", digits=4)
def _(spark, sf):
    d = N.focal_stats(N.spread(V.dense(spark, sf)), mean=["ndre"], std=["ndvi"], spread_of=["ndbi"])
    return d.select("year", "row", "col", *[x for w in (3, 5, 11) for x in (f"ndre_mean{w}", f"ndvi_std{w}", f"ndbi_range{w}")])


_D2 = "(a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)"
_RADII = {50: 2, 100: 3, 250: 8, 500: 17}


def _disk(exprs, radii=_RADII):
    parts = []
    for m, r in radii.items():
        f = f"FILTER (WHERE {_D2} <= {r * r})"
        parts += [e.format(f=f, m=m, r=r) for e in exprs]
    return ", ".join(parts)


def _disk_sql(exprs, post="*", block=_BLOCK, radii=_RADII):
    return f"""
WITH {_G}, k AS (SELECT a.year, a.row, a.col, any_value(a.ndvi) AS ndvi, any_value(a.ndbi) AS ndbi, {_disk(exprs, radii)}
{_JOIN.format(block=block, h=max(radii.values()))} GROUP BY a.year, a.row, a.col)
SELECT {post} FROM k"""


@query("nbr3_disk_aggregate", _disk_sql(
    ["round(coalesce(sum(b.vegetation_cover) {f}, 0), 6) AS veg_sum_{m}m", "count(b.vegetation_cover) {f} AS veg_n_{m}m"],
    "* EXCLUDE (ndvi, ndbi)"), "dense cells_static")
def _(spark, sf):
    d = N.disk_sums(V.dense(spark, sf), ["vegetation_cover"], {}, list(_RADII.values()), keep=[])
    return d.select("year", "row", "col", *[
        x for m, r in _RADII.items()
        for x in (c(f"vegetation_cover_s{r}").alias(f"veg_sum_{m}m"), c(f"vegetation_cover_c{r}").alias(f"veg_n_{m}m"))])


@query("nbr4_disk_contrast", _disk_sql(
    ["avg(b.ndvi) {f} AS v{m}", "avg(b.ndbi) {f} AS b{m}"],
    "year, row, col, " + ", ".join(
        f"round(v{m}, 6) + 0 AS ndvi_disk_mean_{m}m, round(ndvi - v{m}, 6) + 0 AS ndvi_contrast_{m}m, "
        f"round(ndbi - b{m}, 6) + 0 AS ndbi_contrast_{m}m" for m in _RADII)), "dense cells_static")
def _(spark, sf):
    d = N.disk_sums(V.dense(spark, sf), ["ndvi", "ndbi"], {}, list(_RADII.values()), keep=["ndvi", "ndbi"])
    out = []
    for m, r in _RADII.items():
        out += [N.disk_mean("ndvi", r).alias(f"ndvi_disk_mean_{m}m"),
                (c("ndvi") - N.disk_mean("ndvi", r)).alias(f"ndvi_contrast_{m}m"),
                (c("ndbi") - N.disk_mean("ndbi", r)).alias(f"ndbi_contrast_{m}m")]
    return d.select("year", "row", "col", *out)


@query("nbr5_disk_fraction", _disk_sql(
    [f"round(count(*) {{f}} FILTER_{n} / (count(*) {{f}} * 1.0), 6) AS {n}_fraction_{{m}}m".replace(
        f"{{f}} FILTER_{n}", f"FILTER (WHERE {_D2} <= {{r}} * {{r}} AND b.dist_{n}_m = 0)") for n in ("road", "building")],
    "* EXCLUDE (ndvi, ndbi)"), "dense cells_static")
def _(spark, sf):
    flags = {"cell": F.lit(True), "road": c("dist_road_m") == 0, "building": c("dist_building_m") == 0}
    d = N.disk_sums(grid_cells(spark, sf), [], flags, list(_RADII.values()), keep=[])
    return d.select("year", "row", "col", *[
        (c(f"{n}_n{r}") / c(f"cell_n{r}")).alias(f"{n}_fraction_{m}m") for m, r in _RADII.items() for n in ("road", "building")])


_MIX = {100: 3, 250: 8}
_MIX_POST = []
for _m in _MIX:
    _tot = "(" + " + ".join(f"n{k}_{_m}" for k in range(1, 9)) + ")"
    _big = "greatest(" + ", ".join(f"n{k}_{_m}" for k in range(1, 9)) + ")"
    _MIX_POST += [f"round(coalesce(n{k}_{_m} / nullif({_tot} * 1.0, 0), 0), 6) AS frac_{k}_{_m}m" for k in range(1, 9)]
    _MIX_POST.append(f"CASE WHEN {_tot} = 0 THEN 0 " + " ".join(
        f"WHEN n{k}_{_m} = {_big} THEN {k}" for k in range(1, 9)) + f" END AS dominant_{_m}m")
    _MIX_POST.append("round(-(" + " + ".join(
        f"CASE WHEN n{k}_{_m} > 0 THEN (n{k}_{_m} * 1.0 / {_tot}) * ln(n{k}_{_m} * 1.0 / {_tot}) ELSE 0 END"
        for k in range(1, 9)) + f"), 6) + 0 AS entropy_{_m}m")


@query("nbr6_disk_class_mix", _disk_sql(
    [f"count(CASE WHEN b.landuse_class = {k} THEN 1 END) {{f}} AS n{k}_{{m}}" for k in range(1, 9)],
    "year, row, col, " + ", ".join(_MIX_POST), radii=_MIX), "dense cells_static")
def _(spark, sf):
    flags = {k: v for k, v in E.feature_flags().items() if k.startswith("lu")}
    d = N.disk_sums(grid_cells(spark, sf), [], flags, list(_MIX.values()), keep=[])
    out = {}
    for m in _MIX:
        named = E.landuse_sql(m)
        out |= {n.replace("landuse_", ""): x for n, x in named.items()}
    return d.selectExpr("year", "row", "col", *N.named(out))


@query("nbr7_clipping_summary", f"""
WITH k AS (SELECT a.year, a.block_id, a.row, a.col, {_disk(['count(*) {f} AS n{m}'])}
{_JOIN.format(block=_BLOCK, h=17).replace('g a', 'dense a').replace('g b', 'dense b')} GROUP BY ALL)
SELECT year, block_id, count(*) AS n_cells, {', '.join(f"count(*) FILTER (WHERE n{m} < {N.disk_size(r)}) AS clipped_{m}m"
for m, r in _RADII.items())} FROM k GROUP BY year, block_id""", "dense")
def _(spark, sf):
    d = N.disk_sums(V.dense(spark, sf), [], {"cell": F.lit(True)}, list(_RADII.values()), keep=[])
    return d.groupBy("year", "block_id").agg(F.count(F.lit(1)).alias("n_cells"), *[
        F.count_if(c(f"cell_n{r}") < N.disk_size(r)).alias(f"clipped_{m}m") for m, r in _RADII.items()])


@query("nbr8_class_boundary", """
SELECT a.year, a.row, a.col, coalesce(bool_or(b.y_true <> a.y_true), false) AS boundary FROM classed a
LEFT JOIN classed b ON a.year = b.year AND abs(a.row - b.row) + abs(a.col - b.col) = 1
  AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
GROUP BY a.year, a.row, a.col""", "classed")
def _(spark, sf):
    return N.class_boundary(V.classed(spark, sf).select("year", "row", "col", "y_true"), "y_true").drop("y_true")


@query("nbr9_adjacent_gradient", """
SELECT a.year, round(max(abs(a.lst_c - b.lst_c)), 6) AS max_gradient, count(*) AS n_pairs FROM domain a
JOIN domain b ON a.year = b.year AND a.row = b.row AND b.col = a.col - 1 GROUP BY a.year""", "domain")
def _(spark, sf):
    return N.adjacent_gradient(V.domain(spark, sf), "lst_c")


# Levels of the frozen schema; other codes (land use 1 and 3) give all zeros.
_LANDUSE = (0, 2, 4, 5, 6, 7, 8)
_LULC = tuple(range(9))


def schema_order() -> list[str]:
    """The 178 names of the frozen feature schema, in its order."""
    out = ["ndvi", "ndbi", "vegetation_cover", "ndmi", "mndwi", "bsi", "ndre"]
    out += [f"landuse_class_{k}.0" for k in _LANDUSE] + [f"lulc_class_{k}" for k in _LULC]
    out += ["dist_road_m", "dist_vegetation_m", "dist_building_m", "year"]
    out += [f"{v}_mean{w}" for v in E.BASES for w in E.WINDOWS]
    for m in N.RADII_M:
        out += [f"{n}_pixel_fraction_{m}m" for n in ("building", "road", "vegetation")] + [f"vegetation_cover_mean_{m}m"]
        out += [f"landuse_frac_{k}_{m}m" for k in E.LANDUSE] + [f"landuse_dominant_{m}m_{k}" for k in _LANDUSE]
        out += [f"landuse_entropy_{m}m", f"ndvi_contrast_{m}m", f"ndbi_contrast_{m}m"]
    out += MET_OUT
    out += [f"{v}_std{w}" for v in E.STD_BANDS for w in E.WINDOWS] + [f"{v}_mean{w}" for v in E.MEAN_BANDS for w in E.WINDOWS]
    return out + [f"{v}_range{w}" for v in E.RANGE_BANDS for w in E.WINDOWS]


def feature_columns(spark, sf, digits=5):
    """The full stack with its year's weather, one-hot in the frozen order after row, col, block_id, lst_c; doubles of the stack are rounded in its tiles."""
    grid = grid_cells(spark, sf)
    stack = E.feature_stack(grid, digits=digits)
    d = with_weather(spark, sf, stack)

    def level(v, k):
        return F.coalesce((c(v) == k).cast("int"), F.lit(0))

    hot = {f"landuse_class_{k}.0": level("landuse_class", k) for k in _LANDUSE} | {f"lulc_class_{k}": level("lulc_class", k) for k in _LULC}
    hot |= {f"landuse_dominant_{m}m_{k}": level(f"landuse_dominant_{m}m", k) for m in N.RADII_M for k in _LANDUSE}
    out = d.select("row", "col", "block_id", "lst_c", *[hot[n].alias(n) if n in hot else c(n) for n in schema_order()])
    return finish(out, digits, settled=set(stack.columns) - set(grid.columns))


@query("nbr10_feature_table", digits=None)
def _(spark, sf):
    """Every column of the frozen schema; `nbr10_feature_stack` checks some of its families by SQL."""
    return feature_columns(spark, sf)


_STACK_DISK = {50: 2, 500: 17}


@query("nbr10_feature_stack", f"""
WITH {_G}, k AS (SELECT a.year, a.row, a.col, any_value(a.ndvi) AS ndvi,
  {', '.join(_avg(v, w).replace(', 6) + 0', ', 5) + 0') for v in ('ndvi', 'bsi') for w in (3, 11))},
  {_disk(['round(count(CASE WHEN b.dist_road_m = 0 THEN 1 END) {f} / (count(*) {f} * 1.0), 5) AS road_pixel_fraction_{m}m',
          'round(count(CASE WHEN b.landuse_class = 6 THEN 1 END) {f} / (count(CASE WHEN b.landuse_class BETWEEN 1 AND 8 THEN 1 END) {f} * 1.0), 5) AS landuse_frac_6_{m}m',
          'round(any_value(a.ndvi) - avg(b.ndvi) {f}, 5) + 0 AS ndvi_contrast_{m}m'], _STACK_DISK)}
{_JOIN.format(block=_BLOCK, h=17)} GROUP BY a.year, a.row, a.col),
st AS (SELECT a.year, a.row, a.col, round(stddev_pop(b.mndwi), 5) AS mndwi_std5
{_JOIN.format(block='', h=2)} GROUP BY a.year, a.row, a.col)
SELECT k.* REPLACE (round(k.ndvi, 5) AS ndvi), mndwi_std5 FROM k
JOIN st ON k.year = st.year AND k.row = st.row AND k.col = st.col""", "dense cells_static", digits=5)
def _(spark, sf):
    d = E.feature_stack(grid_cells(spark, sf))
    return d.select(
        "year", "row", "col", "ndvi", *[f"{v}_mean{w}" for v in ("ndvi", "bsi") for w in (3, 11)],
        *[x.format(m=m) for m in _STACK_DISK for x in
          ("road_pixel_fraction_{m}m", "landuse_frac_6_{m}m", "ndvi_contrast_{m}m")],
        "mndwi_std5")
