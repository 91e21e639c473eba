"""Embedding near-duplicates against all pairs in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm import subspace


def data(dims, seed=3):
    """Balls of near copies around some centres, loose vectors, exact copies, odd rows."""
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for label in (0, 1, 2):
        for _ in range(6):
            centre = rng.normal(size=dims)
            for _ in range(25):
                noise = rng.normal(size=dims) * np.linalg.norm(centre) / np.sqrt(dims) * rng.choice([0.05, 0.1, 0.14, 0.2])
                out.append((i, (centre + noise).tolist(), label))
                i += 1
        for _ in range(100):
            out.append((i, rng.normal(size=dims).tolist(), label))
            i += 1
    v = out[3][1]
    out += [(i + k, v, 0) for k in range(20)] + [(i + 20, v, 1), (i + 21, [2 * x for x in v], 0), (i + 22, [1e160 * x for x in v], 0)]
    i += 30
    out += [(i, None, 0), (i + 1, [0.0] * dims, 0), (i + 2, [None, *v[1:]], 0), (i + 3, [math.nan, *v[1:]], 0), (i + 4, [math.inf, *v[1:]], 0),
            (i + 5, v, None), (i + 6, [], 0), (i + 7, v[:-1], 0), (i + 8, [1.0] + [0.0] * (dims - 1), 0), (i + 9, [1.0] + [0.0] * (dims - 1), 0)]
    random.Random(1).shuffle(out)
    return out


def plain(rows):
    use = [k for k, (_, v, label) in enumerate(rows)
           if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    unit = {k: np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in use}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    for a in use:
        for b in use:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                near[a].add(b)
                near[b].add(a)
    least, out = {}, []
    for a in sorted(near, key=lambda k: rows[k][0]):
        todo = [] if a in least else [a]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = rows[a][0]
                todo += near[x]
    for k, (i, _, _) in enumerate(rows):
        out.append((i, len(near[k]), least[k]))
    return sorted(out)


@pytest.mark.parametrize("dims,chunk,cell_rows", [(64, 4096, 4096), (20, 16, 8), (3, 16, 16)])
def test_against_all_pairs(spark, dims, chunk, cell_rows):
    rows = data(dims)
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).withColumns({"node": F.lit("n"), "x": F.lit(1), "v": F.lit(2)}).repartition(3)
    got = sorted(tuple(r) for r in subspace.near_duplicates(df, chunk=chunk, cell_rows=cell_rows).select("id", "n_links", "component").collect())
    assert got == plain(rows)


def test_single_precision_and_repeated_ids(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType())])
    rows = [(5, [1.0, 0.0], "a"), (5, [0.0, 1.0], "a"), (None, [1.0, 0.01], "a"), (7, [0.01, 1.0], "a"), (8, [1.0, 0.0], "b")]
    got = sorted(map(tuple, subspace.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 1, None), (5, 1, 5), (None, 1, None), (7, 1, 5), (8, 0, 8)], key=str)


def test_no_rows(spark):
    assert subspace.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_every_link_is_within_budget_in_some_block():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * 0.14
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    close = (x * y).sum(1) / (nx * ny) >= 0.98
    d = ((subspace.rotated(x, nx) - subspace.rotated(y, ny)) ** 2).reshape(len(x), -1, subspace.BLOCK).sum(2)
    assert close.any() and (d[close].min(1) <= subspace.budget(64, 0.98)).all()
