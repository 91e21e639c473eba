"""Rings from pieces: list ranking, outlines of grid zones, and rings of map relations.

A piece names the piece that follows it; no piece is followed twice. What such pieces form, closed rings and
open chains, is found by pointer doubling: every round each piece looks twice as far ahead, so a
ring of n pieces takes log n rounds of one join, whatever its shape. No ring is gathered anywhere.

Outlines of grid zones are settled inside square tiles first; only the stretches that run from one tile
into another are ranked. Orientation tells outer rings from holes. A hole belongs to the outer ring that is met
by going left from it inside the zone: over another hole's edge, if need be, to that hole's outer ring.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.session import cut

TILE = 256
#: The sides of a cell, clockwise from the top: start corner, step, and the cell behind the side.
SIDES = (((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 0), (0, 1)), ((1, 1), (0, -1), (1, 0)), ((1, 0), (-1, 0), (0, -1)))


def rank_lists(pieces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, list, pos, total, closed) of rows (keys, node long, next long or null, len).

    `pos` counts the lengths before a piece: from the ring's least node, or from an open chain's first piece. `list` is that
    least node, or an open chain's last one. `total` is the length of the whole.
    """
    keys = list(keys)
    now = pieces.select(*keys, "node", F.col("next").alias("ptr"), F.col("len").cast("long").alias("span"),
                        F.col("node").alias("least"), F.lit(0).cast("long").alias("at"), F.when(F.col("next").isNull(), F.col("node")).alias("end"))
    now = cut(now)
    while True:
        ahead = now.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("span").alias("_span"),
                           F.col("least").alias("_least"), F.col("at").alias("_at"), F.col("end").alias("_end"))
        seen = now.join(ahead, [*keys, "ptr"], "left")
        nearer = F.col("least") <= F.coalesce("_least", "least")
        moved = seen.select(
            *keys, "node", F.col("_ptr").alias("ptr"), (F.col("span") + F.coalesce("_span", F.lit(0))).alias("span"),
            F.least("least", "_least").alias("least"), F.when(nearer, F.col("at")).otherwise(F.col("span") + F.col("_at")).alias("at"),
            F.coalesce("end", "_end").alias("end"),
            # settled: the end is known, or the least node of this window is that of the next one
            (F.col("ptr").isNull() | (F.col("least") == F.col("_least"))).alias("same"))
        moved = cut(moved)
        now = moved.drop("same")
        if moved.where(~F.col("same")).isEmpty():
            break
    lengths = pieces.select(*keys, "node", F.col("len").cast("long").alias("len"))
    found = now.join(lengths, [*keys, "node"]).withColumns(
        {"closed": F.col("end").isNull(), "list": F.coalesce("end", "least")})
    total = found.groupBy(*keys, "list").agg(F.sum("len").alias("total"))
    found = found.join(total, [*keys, "list"])
    pos = F.when(F.col("closed"), F.pmod(F.col("total") - F.col("at"), F.col("total"))).otherwise(F.col("total") - F.col("span"))
    return found.select(*keys, "node", "list", pos.alias("pos"), "total", "closed")


# --- outlines of zones -----------------------------------------------------------------------------

def piece_id(row, col, side):
    """Of a cell's side; rows and columns from 0 to 2**30."""
    return (row * (1 << 32)) + col * 4 + side


def _outline_tile(row: np.ndarray, col: np.ndarray, zone: np.ndarray, home: np.ndarray) -> dict[str, np.ndarray]:
    """Directed outline pieces of the home cells, zone on the right hand, with what follows each.

    `row` to `zone` cover the tile and the cells around it. A piece's end is left by a turn to the right unless the
    cell ahead on the right is of the zone; straight on unless the one ahead on the left is too: cells that touch
    diagonally keep apart.
    """
    r0, c0 = row.min() - 1, col.min() - 1
    grid = np.zeros((int(row.max() - r0) + 2, int(col.max() - c0) + 2), np.int64)
    grid[row - r0, col - c0] = zone + 1
    hr, hc = (row - r0)[home], (col - c0)[home]
    out = {k: [] for k in ("row", "col", "zone", "side", "next", "turn")}
    for side, (_, (dr, dc), (br, bc)) in enumerate(SIDES):
        z = grid[hr, hc]
        mine = grid[hr + br, hc + bc] != z
        r, c, z = hr[mine], hc[mine], z[mine]
        right = grid[r + dr, c + dc] == z  # ahead, beside the zone's own cell
        left = grid[r + dr + br, c + dc + bc] == z
        turn = np.where(~right, 1, np.where(~left, 0, -1))
        nr = np.where(turn == 1, r, np.where(turn == 0, r + dr, r + dr + br))
        nc = np.where(turn == 1, c, np.where(turn == 0, c + dc, c + dc + bc))
        nxt = piece_id(nr + r0, nc + c0, (side + turn) % 4)
        for k, v in (("row", r + r0), ("col", c + c0), ("zone", z - 1), ("side", np.full(len(r), side)), ("next", nxt), ("turn", turn)):
            out[k].append(v)
    return {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}


def _settle(ids: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first piece of the stretch, place in it, whether it closes here) of a tile's pieces, by pointer doubling."""
    order = np.argsort(ids)
    where = np.searchsorted(ids, nxt, sorter=order)
    where[where == len(ids)] = 0
    follows = order[where]
    inside = ids[follows] == nxt
    before = np.full(len(ids), -1)
    before[follows[inside]] = np.flatnonzero(inside)

    def heads(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        me = np.arange(len(before))
        ptr, far = np.where(before < 0, me, before), (before >= 0).astype(np.int64)
        for _ in range(max(1, int(len(before)).bit_length())):
            far, ptr = far + far[ptr], ptr[ptr]
        return ptr, far

    ptr, far = heads(before)
    closed = before[ptr] >= 0  # never reached a first piece: a ring of this tile
    if closed.any():
        least, jump = ids.copy(), np.where(closed, before, np.arange(len(ids)))
        for _ in range(max(1, int(len(ids)).bit_length())):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        before[closed & (ids == least)] = -1
        ptr, far = heads(before)
    return ids[ptr], far, closed


def outline_pieces(zone_cells: DataFrame, key: str = "year", tile: int = TILE) -> DataFrame:
    """(key, zone_id, ring, pos, length, r, c, dr, dc, turn): every outline piece with its ring and place.

    `ring` is the ring's least piece, which has place 0. `turn` tells what happens at the piece's end.
    """
    cells = zone_cells.select(key, "row", "col", F.col("zone_id").cast("long").alias("zone"))
    near = F.array(*[F.struct(F.floor((F.col("row") + a) / tile).cast("int").alias("tr"), F.floor((F.col("col") + b) / tile).cast("int").alias("tc"))
                     for a in (-1, 0, 1) for b in (-1, 0, 1)])
    around = cells.withColumn("_t", F.explode(F.array_distinct(near))).select(key, "_t.tr", "_t.tc", "row", "col", "zone")
    kind = zone_cells.schema[key]
    schema = T.StructType([kind, *[T.StructField(n, T.LongType()) for n in ("zone", "row", "col", "side", "piece", "turn", "head", "off", "next")],
                           T.StructField("closed", T.BooleanType())])

    def settle(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64)
        home = (row // tile == group[1]) & (col // tile == group[2])
        got = _outline_tile(row, col, pdf["zone"].to_numpy(np.int64), home) if home.any() else {k: np.zeros(0, np.int64) for k in ("row", "col", "zone", "side", "next", "turn")}
        ids = piece_id(got["row"], got["col"], got["side"])
        head, off, closed = _settle(ids, got["next"]) if len(ids) else (ids, ids, ids.astype(bool))
        return pd.DataFrame({key: group[0], "zone": got["zone"], "row": got["row"], "col": got["col"], "side": got["side"], "piece": ids,
                             "turn": got["turn"], "head": head, "off": off, "next": got["next"], "closed": closed})

    pieces = cut(around.groupBy(key, "tr", "tc").applyInPandas(settle, schema))
    # stretches over tile borders: the last piece of each names the first of the next
    open_ = pieces.where(~F.col("closed")).groupBy(key, "head").agg(F.count(F.lit(1)).alias("len"), F.max_by("next", "off").alias("next"))
    ranked = rank_lists(open_.select(key, F.col("head").alias("node"), "next", "len"), [key])
    over = pieces.where(~F.col("closed")).join(ranked.select(key, F.col("node").alias("head"), "list", F.col("pos").alias("_pos")), [key, "head"])
    whole = over.withColumn("pos", F.col("_pos") + F.col("off")).drop("_pos").unionByName(
        pieces.where("closed").withColumns({"list": F.col("head"), "pos": F.col("off")}))
    whole = cut(whole)
    # the same start whatever the tiles: the least piece of the ring
    first = whole.groupBy(key, "list").agg(F.min("piece").alias("ring"), F.min_by("pos", "piece").alias("_first"), F.count(F.lit(1)).alias("length"))
    start = F.array(*[F.struct(F.lit(s[0]).alias("r"), F.lit(s[1]).alias("c"), F.lit(d[0]).alias("dr"), F.lit(d[1]).alias("dc")) for s, d, _ in SIDES])
    p = whole.join(first, [key, "list"]).withColumn("_s", F.element_at(start, (F.col("side") + 1).cast("int")))
    return p.select(
        key, F.col("zone").cast("int").alias("zone_id"), "ring", F.pmod(F.col("pos") - F.col("_first"), F.col("length")).alias("pos"), "length",
        (F.col("row") + F.col("_s.r")).alias("r"), (F.col("col") + F.col("_s.c")).alias("c"), F.col("_s.dr").alias("dr"), F.col("_s.dc").alias("dc"), "turn",
        "row", "col", "side")


def zone_rings(pieces: DataFrame, key: str = "year") -> DataFrame:
    """(key, zone_id, ring, outer, perimeter, n_corners, area, of): rings with their signed area in cells; `of` is a hole's outer ring."""
    keys = [key, "zone_id"]
    # twice the area below a piece; moving right counts up, since rows grow downwards
    rings = pieces.groupBy(*keys, "ring").agg(
        F.first("length").alias("perimeter"), F.count_if(F.col("turn") != 0).alias("n_corners"), F.sum(-F.col("dc") * F.col("r")).alias("area"))
    rings = cut(rings.withColumn("outer", F.col("area") > 0))
    # the edge met on the way left from a hole's least piece: the last left side of that row, at or before its cell
    holes = pieces.where("pos = 0").join(rings.where(~F.col("outer")).select(*keys, "ring"), [*keys, "ring"]).select(*keys, "row", "col", F.col("ring").alias("hole"))
    lefts = pieces.where("side = 3").select(*keys, "row", "col", F.lit(None).cast("long").alias("hole"), F.col("ring").alias("met"))
    rows = lefts.join(holes.select(*keys, "row").distinct(), [*keys, "row"], "left_semi").unionByName(holes.withColumn("met", F.lit(None).cast("long")))
    line = W.partitionBy(*keys, "row").orderBy("col", F.col("hole").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    parent = rows.withColumn("met", F.last("met", ignorenulls=True).over(line)).where("hole is not null").select(*keys, F.col("hole").alias("ring"), "met")
    up = cut(rings.join(parent, [*keys, "ring"], "left").select(*keys, "ring", "outer", F.when(F.col("outer"), F.col("ring")).otherwise(F.col("met")).alias("of")))
    while True:  # a hole met before its outer ring passes on what it met itself
        to = up.select(*keys, F.col("ring").alias("of"), F.col("of").alias("_of"))
        new = cut(up.join(to, [*keys, "of"]).select(*keys, "ring", "outer", F.col("_of").alias("of"), (F.col("_of") == F.col("of")).alias("same")))
        up = new.drop("same")
        if new.where(~F.col("same")).isEmpty():
            break
    return rings.join(up.select(*keys, "ring", F.when(~F.col("outer"), F.col("of")).alias("of")), [*keys, "ring"])


def multipolygons(pieces: DataFrame, rings: DataFrame, x: Column, y: Column, key: str = "year") -> DataFrame:
    """(key, zone_id, polygons): of each zone, every outer ring followed by its holes, closed, in x and y.

    `x` and `y` are Columns of the corner's `r` and `c`. A zone's corners are its one row of output; they meet nowhere else.
    """
    keys = [key, "zone_id"]
    corners = pieces.where("turn <> 0").withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")})
    lines = corners.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("pos", F.array(x, y).alias("p")))).alias("_p"))
    points = F.transform("_p", lambda p: p["p"])
    lines = lines.select(*keys, "ring", F.concat(points, F.array(points[0])).alias("line"))
    whole = lines.join(rings.select(*keys, "ring", "outer", F.coalesce("of", "ring").alias("shell")), [*keys, "ring"])
    polygons = whole.groupBy(*keys, "shell").agg(F.array_sort(F.collect_list(F.struct((~F.col("outer")).alias("hole"), "ring", "line"))).alias("_l"))
    polygons = polygons.select(*keys, "shell", F.transform("_l", lambda l: l["line"]).alias("polygon"))
    return polygons.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shell", "polygon"))).alias("_p")).select(
        *keys, F.transform("_p", lambda p: p["polygon"]).alias("polygons"))


# --- rings of map relations ------------------------------------------------------------------------

def relation_pieces(segments: DataFrame) -> DataFrame:
    """(relation, role, seg, ring, backward, pos, closed, total): members chained end to end.

    `segments` is (relation, role, seg long, a, z, n): end nodes and node count. At a node where more than two members
    end they are joined two by two in the order of their numbers. `ring` is the least member; it is passed from a to z.
    """
    keys = ["relation", "role"]
    s = segments.select(*keys, "seg", "a", "z", (F.col("n") - 1).cast("long").alias("len"))
    alone = s.where("a = z").select(*keys, "seg", F.col("seg").alias("ring"), F.lit(False).alias("backward"), F.lit(0).cast("long").alias("pos"),
                                    F.lit(True).alias("closed"), F.col("len").alias("total"))
    s = cut(s.where("a <> z"))
    ends = s.select(*keys, "seg", F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(0).alias("end")), F.struct(F.col("z").alias("node"), F.lit(1).alias("end")))).alias("e")).select(*keys, "seg", "e.*")
    met = W.partitionBy(*keys, "node").orderBy("seg", "end")
    k = F.row_number().over(met) - 1
    ends = ends.withColumn("_k", k).withColumn("_two", F.expr("_k div 2"))
    # of two ends that meet, each is followed by the other's member, away from the node
    other = W.partitionBy(*keys, "node", "_two").orderBy("_k")
    go = F.struct((F.col("seg") * 2 + F.col("end")).alias("arc"))
    follows = F.coalesce(F.lead(go).over(other), F.lag(go).over(other))["arc"]
    arcs = ends.select(*keys, (F.col("seg") * 2 + 1 - F.col("end")).alias("node"), follows.alias("next"), "seg")
    arcs = cut(arcs.join(s.select(*keys, "seg", "len"), [*keys, "seg"]).drop("seg"))
    ranked = cut(rank_lists(arcs, keys))
    # every chain is there in both directions: that which passes its least member from a to z stays
    least = ranked.groupBy(*keys, "list").agg(F.min("node").alias("_m")).where("_m % 2 = 0")
    chained = ranked.join(least, [*keys, "list"]).select(
        *keys, F.expr("node div 2").alias("seg"), F.expr("_m div 2").alias("ring"), (F.col("node") % 2 == 1).alias("backward"), "pos", "closed", "total")
    return chained.unionByName(alone)


def segment_edges(points: DataFrame) -> DataFrame:
    """(seg, x1, y1, x2, y2) of points (seg, pos, x, y)."""
    after = W.partitionBy("seg").orderBy("pos")
    e = points.select("seg", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(after).alias("x2"), F.lead("y").over(after).alias("y2"))
    return e.where("x2 is not null")


def relation_rings(segments: DataFrame, points: DataFrame, bucket: float = 0.01) -> DataFrame:
    """(relation, role, ring, n_segments, n_points, closed, area, of): rings and open chains of each relation.

    `area` is signed, in the direction that passes the least member from a to z (null for a chain). `of` is an inner
    ring's outer ring: the smallest that holds its first point, by crossing counts within rows of `bucket`.
    """
    keys = ["relation", "role"]
    pieces = cut(relation_pieces(segments))
    edges = cut(segment_edges(points))
    twice = edges.groupBy("seg").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_twice"))
    sign = F.when(F.col("backward"), -1).otherwise(1)
    rings = pieces.join(twice, "seg", "left").groupBy(*keys, "ring").agg(
        F.count(F.lit(1)).alias("n_segments"), (F.max("total") + 1).alias("n_points"), F.min("closed").alias("closed"),
        (F.sum(sign * F.coalesce("_twice", F.lit(0.0))) / 2).alias("_area"))
    rings = cut(rings.withColumn("area", F.when(F.col("closed"), F.col("_area"))).drop("_area"))
    inner = rings.where("role = 'inner' and closed").select("relation", F.col("ring").alias("seg"))
    inner = inner.join(points.where("pos = 0").select("seg", "x", "y"), "seg").select("relation", F.col("seg").alias("inner"), "x", "y", F.floor(F.col("y") / bucket).alias("_b"))
    lines = pieces.where("role <> 'inner' and closed and total > 2").select(  # two edges enclose nothing
        "relation", "ring", "seg").join(edges, "seg")
    low, high = F.floor(F.least("y1", "y2") / bucket), F.floor(F.greatest("y1", "y2") / bucket)
    lines = lines.withColumn("_b", F.explode(F.sequence(low, high)))
    hit = lines.join(inner, ["relation", "_b"]).where("(y1 <= y and y < y2) or (y2 <= y and y < y1)").where(
        F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > F.col("x"))
    holds = hit.groupBy("relation", "inner", "ring").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1")
    outer = rings.where("role <> 'inner'").select("relation", "ring", F.abs("area").alias("_size"))
    of = holds.join(outer, ["relation", "ring"]).groupBy("relation", "inner").agg(F.min_by("ring", F.struct("_size", "ring")).alias("of"))
    of = of.select("relation", F.lit("inner").alias("role"), F.col("inner").alias("ring"), "of")
    return rings.join(of, [*keys, "ring"], "left")
