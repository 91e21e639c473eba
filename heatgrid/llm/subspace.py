"""Embedding near-duplicates of one label by a subspace pigeonhole join.

Two unit vectors of cosine c lie sqrt(2 - 2c) apart. They are rotated (random signs, then a Hadamard
matrix), which spreads any difference over all coordinates, and split into blocks of BLOCK coordinates.
If the whole squared distance is within the budget, some block's is within its proportional share. Each
block is range-joined under that share; candidates of any block are verified by their exact cosine.

Coordinates are rounded to integers before the rotation, which then is exact, so block distances are the
same integers in every task: a pair belongs to the first block that holds it within budget, and is
counted there and nowhere else. The budget allows for the rounding, no pair is lost.

Range join of a block: vectors of one label stand in grid cells over the block's first coordinates (more of
them, the more vectors the label has; cells are wider than the range's diameter). A vector also visits the
neighbouring cells its range reaches, of a pair of cells always from the lower to the higher one. Cells
that hold more than two CHUNKs of rows are counted first and split into pairs of chunks, so that
no task holds more than two chunks. A task returns links per vector and one edge per vector
to the least vector it reaches there, never the pairs.

Exact copies (equal vectors of one label) are one class with a multiplicity before anything is compared.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing; vectors of different lengths are never linked; a null id is one id below all
others; rows that repeat an id count one by one; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.arrays import BASE, mix
from heatgrid.llm.shared import components, id_or_least, id_or_null, kept

SIMILARITY = 0.98
BLOCK = 8
SCALE = 1 << 15
CELL_ROWS = 4096
MAX_DIMS = 4
CHUNK = 4096
TILE = 1 << 21
BATCH = 1 << 15


def vectors_of(column: pa.Array, single: bool) -> list[bytes | None]:
    """The usable vectors as bytes, scaled by a power of two where squares could overflow or vanish."""
    out: list[bytes | None] = []
    kind = "<f4" if single else "<f8"
    for v in column:
        x = None if not v.is_valid else v.values
        if x is None or not len(x) or x.null_count:
            out.append(None)
            continue
        x = x.to_numpy(zero_copy_only=False).astype("<f8")
        most = np.abs(x).max()
        if not np.isfinite(most) or most == 0:
            out.append(None)
            continue
        if most > 1e30 or most < 1e-30:
            x = np.ldexp(x, -int(np.frexp(most)[1]))
            x[np.abs(x) < 1e-40] = 0.0  # far below what single or double precision of the sum shows
        out.append((x + 0.0).astype(kind).tobytes())
    return out


def signs(width: int) -> np.ndarray:
    return np.where(mix(np.arange(1, width + 1, dtype=np.uint64) * BASE) >> np.uint64(63), 1.0, -1.0)


def width_of(dims: int) -> int:
    """Rotated vectors have a power of two of coordinates, whole blocks of them."""
    return max(BLOCK, 1 << (dims - 1).bit_length())


def rotated(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Integer coordinates (as doubles) of the rotated unit vectors: rows of x over their norms."""
    q = np.rint(x / norm[:, None] * SCALE)
    width = width_of(x.shape[1])
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = q
    y *= signs(width)
    h = 1
    while h < width:  # fast Walsh-Hadamard: sums and differences of integers, exact
        z = y.reshape(len(x), -1, 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(x), width)
        h *= 2
    return y


def budget(dims: int, similarity: float) -> int:
    """A block's share of the squared distance, in units of the rotated integers, with room for rounding."""
    far = SCALE * np.sqrt(max(0.0, 2 - 2 * similarity) + 1e-9) + np.sqrt(dims) + 1
    return int(np.ceil(BLOCK * far * far))


def cells_of(y: np.ndarray, room: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, role) of a block's coordinates over `dims` grid axes: role 0 at home, 1 as a visitor."""
    if dims == 0:
        return np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y), np.int8)
    side = np.ceil(2.26 * np.sqrt(room))
    y = y[:, :dims]
    at = np.floor(y / side)
    low, up = y - at * side, (at + 1) * side - y
    step = np.where(low <= up, -1, 1)
    gap = np.minimum(low, up) ** 2
    at = at.astype(np.int64)
    rows, cells, roles = [], [], []
    for subset in range(1 << dims):
        use = np.array([subset >> k & 1 for k in range(dims)], bool)
        ok = (gap[:, use].sum(1) <= room)
        if subset:
            ok &= step[:, int(np.argmax(use))] > 0  # only towards the higher cell
        some = np.flatnonzero(ok)
        key = np.zeros(len(some), np.int64)
        for k in range(dims):
            key = (key << 16) + (at[some, k] + (step[some, k] if use[k] else 0) + 0x4000)
        rows.append(some)
        cells.append(key)
        roles.append(np.full(len(some), 1 if subset else 0, np.int8))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(roles)


class Forest:
    """Least row each row reaches, by links that come in batches."""

    def __init__(self, n: int) -> None:
        self.to = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.to[i], self.to[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.to, np.maximum(a, b), np.minimum(a, b))
            while True:
                nxt = self.to[self.to]
                if (nxt == self.to).all():
                    break
                self.to = nxt


def links_of(x: np.ndarray, norm: np.ndarray, left: int, itself: bool, block: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of one block from rows [0, left) to the rows from `left` on, and among the first if `itself`, verified.

    Returns the links (i, j) that belong to this block and the least row each row reaches by them.
    """
    y = rotated(x, norm)
    room = budget(x.shape[1], similarity)
    unit = x / norm[:, None]
    b = y[:, block * BLOCK:(block + 1) * BLOCK]
    size = (b * b).sum(1)
    forest = Forest(len(x))
    found_i, found_j = [], []
    tile = max(1, TILE // max(1, len(x)))
    for r in range(0, left, tile):
        to = min(left, r + tile)
        start = r if itself else left
        near = size[r:to, None] + size[None, start:] - 2 * (b[r:to] @ b[start:].T) <= room
        i, j = np.nonzero(near)
        i, j = i + r, j + start
        ok = i < j
        i, j = i[ok], j[ok]
        for s in range(0, len(i), BATCH):
            p, q = i[s:s + BATCH], j[s:s + BATCH]
            for earlier in range(block):  # the pair belongs to the first block that holds it
                d = y[p, earlier * BLOCK:(earlier + 1) * BLOCK] - y[q, earlier * BLOCK:(earlier + 1) * BLOCK]
                mine = (d * d).sum(1) > room
                p, q = p[mine], q[mine]
            close = np.einsum("ij,ij->i", unit[p], unit[q])
            edge = np.abs(close - similarity) < 1e-12
            if edge.any():  # at the threshold, the plain quotient decides
                dot = np.einsum("ij,ij->i", x[p[edge]], x[q[edge]])
                close[edge] = dot / (norm[p[edge]] * norm[q[edge]])
            p, q = p[close >= similarity], q[close >= similarity]
            forest.add(p, q)
            found_i.append(p.astype(np.int32))
            found_j.append(q.astype(np.int32))
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return cat(found_i), cat(found_j), forest.to


NAMES = ["block", "label", "dims", "cell", "role", "node", "times", "v"]
KEY = ["block", "label", "dims", "cell"]


def unpacked(values: pa.Array, dims: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and their norms."""
    x = np.frombuffer(b"".join(v.as_py() for v in values), kind).reshape(-1, dims).astype(np.float64)
    return x, np.sqrt((x * x).sum(1))


def placed(classes: DataFrame, blocks: list[int], similarity: float, kind: str) -> DataFrame:
    """A row for each cell of the named blocks that a vector stands in or visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = np.stack([batch.column(1).to_numpy(), batch.column(5).to_numpy()], 1)
            for dims, axes in np.unique(shape, axis=0).tolist():
                part = batch.take(pa.array(np.flatnonzero((shape == [dims, axes]).all(1))))
                for a in range(0, len(part), 2048):
                    piece = part.slice(a, 2048)
                    y = rotated(*unpacked(piece.column(4), dims, kind))
                    for block in blocks:
                        if block * BLOCK >= y.shape[1]:
                            continue
                        at, cells, roles = cells_of(y[:, block * BLOCK:(block + 1) * BLOCK], budget(dims, similarity), axes)
                        got = piece.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), block, np.int32)), got.column(0), got.column(1), pa.array(cells), pa.array(roles),
                             got.column(2), got.column(3), got.column(4)], NAMES)

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dims", "node", "times", "v", "axes").mapInArrow(
        rows, f"block int, label {label}, dims int, cell long, role byte, node long, times long, v binary")


def large_cells(classes: DataFrame, blocks: list[int], similarity: float, kind: str, chunk: int) -> DataFrame:
    """(KEY, nh, nw): the cells that hold more than two chunks of rows, and into how many chunks homes and visitors go."""
    home, visit = F.count_if(F.col("role") == 0), F.count_if(F.col("role") == 1)
    return (placed(classes, blocks, similarity, kind).groupBy(*KEY).agg(home.alias("h"), visit.alias("w"))
            .where(F.col("h") + F.col("w") > 2 * chunk)
            .select(*KEY, F.ceil(F.col("h") / chunk).alias("nh"), F.ceil(F.col("w") / chunk).alias("nw")))


def block_hits(classes: DataFrame, large: DataFrame, block: int, similarity: float, kind: str) -> DataFrame:
    """(node, n, reach) of one block's range join: links found in a task and the least node reached in it."""
    here = placed(classes, [block], similarity, kind)
    place = F.pmod(F.xxhash64("node"), F.when(F.col("role") == 0, F.col("nh")).otherwise(F.col("nw")))
    tasks = F.expr("""
        CASE WHEN nh IS NULL THEN array(named_struct('i', 0L, 't', 0L, 'right', cast(role AS BOOLEAN)))
             WHEN role = 0 THEN concat(transform(sequence(c, nh + nw - 1), t -> named_struct('i', c, 't', t, 'right', false)),
                                       filter(transform(sequence(0L, c), i -> named_struct('i', i, 't', c, 'right', true)), x -> x.i < c))
             ELSE transform(sequence(0L, nh - 1), i -> named_struct('i', i, 't', nh + c, 'right', true)) END""")
    dealt = (here.join(large.where(F.col("block") == block), KEY, "left").where("nh IS NULL OR nh > 0").withColumn("c", place.cast("long"))
             .withColumn("task", F.explode(tasks)).select(*KEY, "task.i", "task.t", "task.right", "node", "times", "v"))

    def compared(table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("node").to_numpy(), right))
        left = int((~right).sum())
        table = table.take(pa.array(order))
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        if len(node) < 2 or left == 0:
            return pa.table({c: pa.array([], pa.int64()) for c in ("node", "n", "reach")})
        x, norm = unpacked(table.column("v"), table.column("dims")[0].as_py(), kind)
        itself = table.column("i")[0].as_py() == table.column("t")[0].as_py()
        i, j, to = links_of(x, norm, left, itself, block, similarity)
        n = np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))
        some = np.flatnonzero(n > 0)
        return pa.table({"node": node[some], "n": n[some].astype(np.int64), "reach": node[to[some]]})

    return dealt.groupBy(*KEY, "i", "t").applyInArrow(compared, "node long, n long, reach long")


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = SIMILARITY, chunk: int = CHUNK, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(id, n_links, component) of every row: other vectors linked directly, smallest id reachable by links."""
    single = rows.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    label = rows.schema[label_col].dataType.simpleString()
    source = rows.select(id_or_least(id_col).alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("x"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                v = vectors_of(part.column(2), single)
                v = [x if ok else None for x, ok in zip(v, part.column(1).is_valid().to_pylist())]
                name = [xxhash.xxh3_128_digest(x) if x else None for x in v]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) // (4 if single else 8) if x else 0 for x in v], pa.int32()),
                     pa.array(name, pa.binary()), pa.array(v, pa.binary())], ["id", "label", "dims", "name", "v"])

    usable = source.mapInArrow(named, f"id long, label {label}, dims int, name binary, v binary")
    classes = usable.where("v IS NOT NULL").groupBy("label", "dims", "name").agg(
        F.count(F.lit(1)).alias("times"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))
    members = kept(usable.drop("v"))
    sizes = classes.df.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("rows"))
    # one more grid axis for every factor of two in the size of a label
    axes: Column = F.greatest(F.lit(0), F.least(F.lit(MAX_DIMS), F.ceil(F.log2(F.col("rows") / cell_rows)))).cast("int")
    gridded = kept(classes.df.join(sizes.select("label", "dims", axes.alias("axes")), ["label", "dims"]).drop("name", "least"))
    widest = classes.df.agg(F.max("dims")).first()[0] or 0
    blocks = list(range(width_of(widest) // BLOCK if widest else 0))
    large = kept(large_cells(gridded.df, blocks, similarity, kind, chunk))
    # one block after the other: no more than one block's copies are shuffled at a time
    hits = [kept(block_hits(gridded.df, large.df, b, similarity, kind)) for b in blocks]
    gridded.discard()
    if hits:
        every = reduce(DataFrame.unionByName, [h.df for h in hits])
        counts = every.groupBy("node").agg(F.sum("n").alias("n"))
        roots = components(every.select(F.col("node").alias("u"), F.col("reach").alias("v")).where("u <> v"))
        found = classes.df.drop("v").join(counts, "node", "left").join(roots, "node", "left")
    else:
        found = classes.df.drop("v").withColumns({"n": F.lit(0).cast("long"), "root": F.col("node")})
    found = kept(found.withColumn("root", F.coalesce("root", "node"))).df
    smallest = found.groupBy("root").agg(F.min("least").alias("component"))
    links = F.coalesce("n", F.lit(0).cast("long")) + F.col("times") - 1
    found = kept(found.join(smallest, "root").select("label", "dims", "name", links.alias("n_links"), "component")).df
    joined = members.df.join(found, ["label", "dims", "name"], "left").withColumn("component", F.coalesce("component", "id"))
    return joined.select(id_or_null("id").alias("id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), id_or_null("component").alias("component"))
