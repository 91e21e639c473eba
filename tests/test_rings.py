"""Outlines of zones and rings of relations against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatgrid.operators import components as G
from heatgrid.operators import rings as RG

TURN = {(0, 1): (1, 0), (1, 0): (0, -1), (0, -1): (-1, 0), (-1, 0): (0, 1)}


def plain_rings(cells):
    """Sorted (perimeter, corners, signed area) of one zone's rings, by walking its outline."""
    out = {}
    for r, c in cells:
        for (sr, sc), d, (br, bc) in RG.SIDES:
            if (r + br, c + bc) not in cells:
                out.setdefault((r + sr, c + sc), []).append(d)
    rings = []
    while out:
        start = min(out)
        d = sorted(out[start])[0]
        first, at, path = (start, d), start, []
        while True:
            out[at].remove(d)
            if not out[at]:
                del out[at]
            path.append((at, d))
            at = (at[0] + d[0], at[1] + d[1])
            choice = out.get(at, [])
            if at == first[0] and (not choice or TURN[d] not in choice):
                break
            d = TURN[d] if TURN[d] in choice else choice[0]
        corners = sum(path[i][1] != path[i - 1][1] for i in range(len(path)))
        rings.append((len(path), corners, -sum(d[1] * at[0] for at, d in path)))
    return sorted(rings)


def labelled(seed, h, w, share):
    """A random mask, its 8-connected zones by plain search."""
    rng = np.random.default_rng(seed)
    left = {(int(r), int(c)) for r, c in np.argwhere(rng.random((h, w)) < share)}
    zones = []
    while left:
        todo, zone = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            zone.add((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        zones.append(zone)
    return zones


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_outlines_whatever_the_tile(spark, tile):
    zones = labelled(4, 30, 37, 0.55) + [{(r, 60 + c) for r in range(20) for c in range(20)} - {(5 + r, 65 + c) for r in range(9) for c in range(9)} | {(9, 69)}]
    rows = [(2022, z, r, c) for z, zone in enumerate(zones) for r, c in zone]
    df = spark.createDataFrame(rows, "year int, zone_id int, row int, col int").repartition(3)
    pieces = RG.outline_pieces(df, tile=tile).cache()
    rings = RG.zone_rings(pieces).collect()
    for z, zone in enumerate(zones):
        mine = [r for r in rings if r["zone_id"] == z]
        assert sorted((r["perimeter"], r["n_corners"], r["area"]) for r in mine) == plain_rings(zone)
        assert sum(r["area"] for r in mine) == len(zone)
        outer = {r["ring"] for r in mine if r["outer"]}
        assert all((r["of"] is None) == r["outer"] and (r["outer"] or r["of"] in outer) for r in mine)
    # places follow one another along each ring
    got = {}
    for p in pieces.collect():
        got.setdefault(p["ring"], {})[p["pos"]] = p
    for ring in got.values():
        n = len(ring)
        assert sorted(ring) == list(range(n))
        for i in range(n):
            a, b = ring[i], ring[(i + 1) % n]
            assert (a["r"] + a["dr"], a["c"] + a["dc"]) == (b["r"], b["c"])
            assert (a["turn"] != 0) == ((a["dr"], a["dc"]) != (b["dr"], b["dc"]))


def test_holes_hang_below_the_ring_round_them(spark):
    """A ring of cells with a zone cell inside its hole, of the same zone; two holes in that."""
    solid = {(r, c) for r in range(12) for c in range(12)}
    zone = (solid - {(r, c) for r in range(2, 10) for c in range(2, 10)}) | {(r, c) for r in range(4, 8) for c in range(4, 8)}
    zone = (zone - {(5, 5), (6, 6)}) | {(20, c) for c in range(3)}
    df = spark.createDataFrame([(1, 1, r, c) for r, c in zone], "year int, zone_id int, row int, col int")
    pieces = RG.outline_pieces(df, tile=5).cache()
    rings = RG.zone_rings(pieces)
    got = {r["ring"]: r for r in rings.collect()}
    size = sorted((got[r["of"]]["perimeter"], r["area"]) for r in got.values() if not r["outer"])
    assert size == [(16, -2), (48, -64)]  # holes that touch diagonally are one
    polygons = RG.multipolygons(pieces, rings, F.col("c").cast("double"), -F.col("r").cast("double")).first()["polygons"]
    assert sorted(len(p) for p in polygons) == [1, 2, 2]
    assert all(line[0] == line[-1] for p in polygons for line in p)
    lengths = sorted(len(line) - 1 for p in polygons for line in p)
    assert lengths == [4, 4, 4, 4, 8]


def test_long_lists_and_rings(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(10**9), 700)
    ring, chain, one = nodes[:400], nodes[400:699], nodes[699]
    rows = [(a, b, 1 + a % 3) for a, b in zip(ring, ring[1:] + ring[:1])] + [(a, b, 1 + a % 3) for a, b in zip(chain, chain[1:] + [None])] + [(one, one, 5)]
    got = {r["node"]: r for r in RG.rank_lists(spark.createDataFrame(rows, "node long, next long, len int")).collect()}
    k = ring.index(min(ring))
    for path, closed, name in ((ring[k:] + ring[:k], True, min(ring)), (chain, False, chain[-1]), ([one], True, one)):
        at = 0
        for n in path:
            assert (got[n]["pos"], got[n]["closed"], got[n]["list"]) == (at, closed, name)
            at += 5 if n == one else 1 + n % 3
        assert {got[n]["total"] for n in path} == {at}


def test_relation_rings(spark):
    """A square of three members with two holes, one of them outside it; an open chain; a node where four members end."""
    ways = {
        10: ("outer", [(0, 0), (10, 0), (10, 10)]), 11: ("outer", [(0, 0), (0, 10)]), 12: ("outer", [(0, 10), (5, 10), (10, 10)]),
        20: ("inner", [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]), 21: ("inner", [(20, 20), (21, 20), (21, 21), (20, 20)]),
        30: ("outer", [(50, 50), (51, 51)]), 31: ("outer", [(51, 51), (53, 50)]),
        40: ("outer", [(70, 0), (71, 0), (71, 1)]), 41: ("outer", [(71, 1), (70, 0)]), 42: ("outer", [(70, 0), (69, 0), (69, -1)]), 43: ("outer", [(69, -1), (70, 0)])}
    node = {}
    seg, pts = [], []
    for w, (role, line) in ways.items():
        a, z = (node.setdefault(p, len(node)) for p in (line[0], line[-1]))
        seg.append((7, role, w, a, z, len(line)))
        pts += [(w, i, float(x), float(y)) for i, (x, y) in enumerate(line)]
    rings = RG.relation_rings(spark.createDataFrame(seg, "relation long, role string, seg long, a long, z long, n int"),
                              spark.createDataFrame(pts, "seg long, pos int, x double, y double"), bucket=3.0)
    got = {r["ring"]: r for r in rings.collect()}
    assert {k: (r["n_segments"], r["n_points"], r["closed"], r["area"], r["of"]) for k, r in got.items() if k < 40} == {
        10: (3, 6, True, 100.0, None), 20: (1, 5, True, 4.0, 10), 21: (1, 4, True, 0.5, None), 30: (2, 3, False, None, None)}
    assert sum(r["n_segments"] for k, r in got.items() if k >= 40) == 4 and all(r["closed"] for k, r in got.items() if k >= 40)


def test_no_zones(spark):
    df = spark.createDataFrame([], "year int, zone_id int, row int, col int")
    pieces = RG.outline_pieces(df)
    assert pieces.count() == 0 and RG.zone_rings(pieces).count() == 0


def test_zone_edges_of_a_diagonal_touch(spark):
    cells = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(3, 3)]
    df = spark.createDataFrame([(1, 1, r, c) for r, c in cells], "year int, zone_id int, row int, col int")
    assert G.zone_edges(df).count() == 20
    assert sorted(r["perimeter"] for r in RG.zone_rings(RG.outline_pieces(df)).collect()) == [4, 4, 12]
