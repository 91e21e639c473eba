"""8-connected components of cell masks and zone attributes; their rings are in `rings`.

Cells are labelled inside square tiles first (a task sees one tile, at most tile x tile cells).
Only cells on tile borders are then matched with their neighbours across the border, which
leaves a small graph of tile components; minimum-label rounds with shortcuts settle that graph,
each round written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.session import cut

TILE = 256


def _label_tile(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Component label (lowest position in raster order) of each cell of one tile, rows sorted."""
    r0, c0 = row.min(), col.min()
    h, w = int(row.max() - r0) + 1, int(col.max() - c0) + 1
    grid = np.full((h + 2, w + 2), -1, dtype=np.int64)
    y, x = row - r0 + 1, col - c0 + 1
    pos = np.arange(len(row))
    grid[y, x] = pos
    parent = pos.copy()
    while True:
        grid[y, x] = parent
        near = parent.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                n = grid[y + dy, x + dx]
                near = np.where((n >= 0) & (n < near), n, near)
        # Hang each root below the least label seen by any of its cells, then shorten the paths.
        new = parent.copy()
        np.minimum.at(new, parent, near)
        new = np.minimum(new, near)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == parent).all():
            return parent
        parent = new


def min_label_graph(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root): least node of each connected component of an undirected edge list.

    Alternates two steps on shrinking edges: every node points its larger neighbours at its
    least one, then its smaller ones; the edges end as stars round the least nodes. A node with
    very many edges is combined map-side by the minimum before any row is moved.
    """
    keys = list(keys)

    def step(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))) if larger else (
            e.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(least, [*keys, "u"])
        if larger:
            out = j.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(*keys, "u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        """Count and two 64-bit hash sums of a set of edges: equal for equal sets, in one pass without a shuffle of edges."""
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "u", "v")),
                           F.sum(F.xxhash64(F.lit(1), *keys, "u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select(*keys, "u", "v").where("u <> v").distinct())
    seen = mark(e)
    while True:
        new = cut(step(step(e, True), False))
        now = mark(new)
        if now == seen:
            break
        e, seen = new, now
    stars = new.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(*keys, F.col("root").alias("node"), "root").distinct())


def label_components(
    mask: DataFrame, keys: Sequence[str] = ("year",), min_px: int = 1, tile: int = TILE
) -> DataFrame:
    """(keys, row, col, zone_id, n_px): components of at least `min_px` cells.

    Ids are dense per key, in raster order of each component's first cell.
    """
    keys = list(keys)
    cells = mask.select(*keys, "row", "col")
    cells = cells.withColumns({
        "_tr": F.floor(F.col("row") / tile).cast("int"), "_tc": F.floor(F.col("col") / tile).cast("int")})
    schema = T.StructType(cells.schema.fields + [T.StructField("comp", T.LongType())])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["row", "col"]).sort_values(["row", "col"]).reset_index(drop=True)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _label_tile(r, c)
        pdf["comp"] = (r[first].astype(np.int64) << 32) | c[first].astype(np.int64)
        return pdf

    tiles = cut(cells.groupBy(*keys, "_tr", "_tc").applyInPandas(local, schema))
    rim = tiles.where(
        (F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    across = (
        rim.withColumn("_o", F.explode(F.array(*[
            F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])))
        .select(*keys, (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"),
                F.col("comp").alias("u"), F.col("_tr").alias("_ar"), F.col("_tc").alias("_ac")))
    edges = (
        across.join(rim.withColumnRenamed("comp", "v"), [*keys, "row", "col"])
        .where((F.col("_ar") != F.col("_tr")) | (F.col("_ac") != F.col("_tc"))).select(*keys, "u", "v").distinct())
    edges = cut(edges)
    # From here on tile components stand for their cells, so that no join of cells is keyed by a whole zone.
    comps = tiles.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("_cells"))
    if edges.isEmpty():
        comps = comps.withColumn("root", F.col("comp"))
    else:
        roots = min_label_graph(edges, keys).withColumnRenamed("node", "comp")
        comps = comps.join(roots, [*keys, "comp"], "left").withColumn("root", F.coalesce("root", "comp"))
    comps = cut(comps)
    sizes = comps.groupBy(*keys, "root").agg(F.sum("_cells").cast("int").alias("n_px")).where(F.col("n_px") >= min_px)
    # Dense ids: number within bands of grid rows, then add the count of the bands before.
    band = F.floor(F.shiftright(F.col("root"), 32) / tile)
    sizes = sizes.withColumn("_band", band)
    before = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_m")).withColumn(
        "_off", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    ids = sizes.join(offs, [*keys, "_band"]).withColumn(
        "zone_id", (F.col("_off") + F.row_number().over(W.partitionBy(*keys, "_band").orderBy("root"))).cast("int"))
    named = comps.join(ids.select(*keys, "root", "zone_id", "n_px"), [*keys, "root"]).select(*keys, "comp", "zone_id", "n_px")
    return tiles.join(named, [*keys, "comp"]).select(*keys, "row", "col", "zone_id", "n_px")


def zone_edges(zone_cells: DataFrame, keys: Sequence[str] = ("year", "zone_id")) -> DataFrame:
    """Outline sides: those of a zone's cell sides met once only, as (keys, r1, c1, r2, c2)."""
    sides = F.array(*[
        F.struct(*[(F.col(a) + d).alias(n) for a, d, n in
                   (("row", r1, "r1"), ("col", c1, "c1"), ("row", r2, "r2"), ("col", c2, "c2"))])
        for r1, c1, r2, c2 in ((0, 0, 0, 1), (1, 0, 1, 1), (0, 0, 1, 0), (0, 1, 1, 1))])
    s = zone_cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return s.groupBy(*keys, "r1", "c1", "r2", "c2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
