"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A document is the set of its distinct word 5-grams (64-bit hashes), ordered by a global order that puts
rare ones first. The order comes from counters of a fixed number of cells, summed over all documents;
any order gives right results, a good one gives few candidates. Documents with equal sets are one class.

If two sets reach the threshold, then for every l the prefixes of length n - ceil(t n) + l share l
tokens. Each document picks its l by estimated cost: looking at the tokens of the longer prefix
against verifying the candidates that l shared tokens leave. A pair must share the smaller of both l.

Candidates are met without pairing a group with itself:
1. Entries are shuffled once, by token. Tokens found in one class only are dropped; they can join nothing.
   Every other entry learns its token's most central class (the one with fewest rarer tokens).
2. Star: every class meets the central class, is filtered by size, position and number of shared
   tokens, and verified exactly. Near copies of one text become one component here, with as many pairs
   as classes.
3. Rest: what links could still be missing lie between components. On each token, only classes outside
   the centre's component meet the others, in the same band of sizes or the next, under the same filters
   and the exact check.
Candidates first compare histograms of their sets, whose cells bound what two sets can share. Verification
reads the texts of the classes left, no others, and compares sets made from them again; a class of very
many pairs is dealt to several tasks.

Components are those of all links: pairs inside one component need no check.

Defined cases: fewer words than `SHINGLE` make the whole sequence one shingle; no words, or null text,
make an empty set that is linked with nothing; null ids are one id below all others; rows that repeat
an id are looked at one by one and each get their component; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.arrays import batch_bytes, inside, mix, spans, texts_of, window_hashes, word_names
from heatgrid.llm.shared import Kept, bitmap, components, id_or_least, id_or_null, in_bitmap, kept

SHINGLE = 5
PERCENT = 80
CELL_BITS = 20
SLICE_BITS = 14
LONGEST = 4
VERIFY_COST = 8.0
MOST_BITS = 28
HOT = 1 << 20
FEW = 64
SMALL = 16


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the word 5-grams of each text, in order, repeats included."""
    data, offsets = batch_bytes(column)
    starts, ends, at = spans(data, offsets)
    names = word_names(data, starts, ends, lower=True)
    n = np.diff(at)
    counts = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    where = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=where[1:])
    out = np.empty(int(where[-1]), np.uint64)
    full = np.repeat(n >= SHINGLE, counts)
    out[full] = window_hashes(names, SHINGLE)[inside(at, SHINGLE)]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        if len(short):
            total = names[at[short]].copy()
            for j in range(1, k):
                total = mix(total) + names[at[short] + j]
            out[where[short]] = mix(total + np.uint64(k))
    return out, where


def sketch(texts: DataFrame) -> np.ndarray:
    """Counters of all shingles of all documents, 2**CELL_BITS cells; partitions are summed in tasks."""
    size = 1 << SLICE_BITS
    slices = (1 << CELL_BITS) // size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for a, b in texts_of(batch.column(1)):
                h = shingles(batch.column(1).slice(a, b - a))[0]
                cells += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        rows = [zlib.compress(cells[i * size:(i + 1) * size].astype("<i8").tobytes(), 1) for i in range(slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(rows, pa.binary())], ["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(cells.as_py()), "<i8")
                total[i] = total[i] + part if i in total else part
        rows = [zlib.compress(x.tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], ["slice", "cells"])

    schema = "slice int, cells binary"
    out = np.zeros(1 << CELL_BITS, np.int64)
    for r in texts.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():
        out[r["slice"] * size:(r["slice"] + 1) * size] += np.frombuffer(zlib.decompress(bytes(r["cells"])), "<i8")
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def class_id(u: np.ndarray) -> int:
    """64-bit name of a set, given its sorted distinct members."""
    return int(mix(np.array([mix(u ^ np.uint64(0x5E7)).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def prefix(u: np.ndarray, cells: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """(tokens of the chosen prefix in global order, the l chosen)."""
    n = len(u)
    often = cells[(u >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    base = n - (PERCENT * n + 99) // 100
    most = min(base + LONGEST, n)
    order = np.lexsort((u, often))[:most]
    cost = np.cumsum(np.maximum(often[order] - noise, 0.0))
    ls = np.arange(1, most - base + 1)
    seen = cost[base + ls - 1]
    level = int(np.argmin(seen * (1 + VERIFY_COST / ls))) + 1
    return u[order[:base + level]], level


def histogram(u: np.ndarray) -> bytes:
    """How many members of a set fall into each of about a quarter as many cells, by their lowest bits (255 stands for more)."""
    cells = 1 << max(0, (len(u) // 4).bit_length())
    return np.minimum(np.bincount((u & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int | None:
    """No two sets with these histograms share more members; None if a cell is too full to tell."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return None
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, n).sum(0, dtype=np.int64), b.reshape(-1, n).sum(0, dtype=np.int64)).sum())


def prefixes(texts: DataFrame, cells: np.ndarray) -> DataFrame:
    """(doc, cls, n, level, tokens, hist) of each row (doc, t): class, set size, l, prefix and histogram."""
    shared = texts.sparkSession.sparkContext.broadcast(cells)  # 2**CELL_BITS counters, whatever the input
    noise = float(cells.mean() + 3 * np.sqrt(cells.mean()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in texts_of(batch.column(1)):
                h, at = shingles(batch.column(1).slice(a, b - a))
                cls, sizes, levels, tokens, hists = [], [], [], [], []
                for i in range(b - a):
                    u = np.unique(h[at[i]:at[i + 1]])
                    sizes.append(len(u))
                    hists.append(histogram(u))
                    if len(u):
                        cls.append(class_id(u))
                        p, level = prefix(u, counters, noise)
                    else:  # a class of its own
                        cls.append(int(mix(np.array([docs[a + i]], np.int64).view(np.uint64)).view(np.int64)[0]))
                        p, level = u, 1
                    levels.append(level)
                    tokens.append(p.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a:b]), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(levels, pa.int8()),
                     pa.array(tokens, pa.list_(pa.int64())), pa.array(hists, pa.binary())], ["doc", "cls", "n", "level", "tokens", "hist"])

    return texts.mapInArrow(rows, "doc long, cls long, n int, level byte, tokens array<long>, hist binary")


def partnered(group: np.ndarray, again: np.ndarray, pos: np.ndarray, cls: np.ndarray, n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Whether a row may link with any other of its group; rows of groups of more than SMALL classes all may."""
    rows = np.flatnonzero(~again)
    g = group[rows]
    some = (np.bincount(g, minlength=int(group[-1]) + 1) > SMALL)[g]
    for d in range(1, SMALL):
        a, b = rows[:-d], rows[d:]
        extra = np.minimum(level[a], level[b]) - 1
        rest = np.minimum(n[a] - pos[a], n[b] - pos[b]) + extra
        ok = ((g[:-d] == g[d:]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
              & ((100 + PERCENT) * rest >= PERCENT * (n[a] + n[b])))
        some[:-d] |= ok
        some[d:] |= ok
    out = np.zeros(len(group), bool)
    out[rows] = some
    return out


def grouped(sets: DataFrame, cells: np.ndarray, hot: int) -> DataFrame:
    """Prefix entries by token, each with its token's most central class (p_*); tokens of one class only are dropped, and
    in small groups those entries that pass the filters with no other of the group.

    One shuffle by token, then one pass over the sorted rows that keeps a group's first row and no others, so a
    group may be of any size. Tokens that the counters put above `hot` rows are dealt to several tasks by
    class; each part has a centre of its own (part 0 is a token that was not dealt out).
    """
    shared = sets.sparkSession.sparkContext.broadcast(cells)

    @F.arrow_udf("array<int>")
    def parts(tokens: pa.Array, cls: pa.Array) -> pa.Array:
        flat = tokens.flatten().to_numpy().view(np.uint64)
        lengths = np.diff(tokens.offsets.to_numpy())
        times = shared.value[(flat >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.int64)
        name = np.repeat(mix(cls.to_numpy().view(np.uint64)) >> np.uint64(32), lengths).astype(np.int64)
        part = np.where(times > hot, name % (times // hot + 1) + 1, 0).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(part))

    both = F.posexplode(F.arrays_zip("tokens", "parts")).alias("pos", "t")
    rows = (sets.withColumn("parts", parts("tokens", "cls")).select("cls", "n", "level", both)
            .select(F.col("t.tokens").alias("token"), F.col("t.parts").alias("part"), "pos", "cls", "n", "level"))
    fields = ["pos", "cls", "n", "level"]
    names = ["token", "part", *fields, *[f"p_{c}" for c in fields]]

    def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waits = None, False  # the first row of the group at the end of the last batch; is it still to be returned
        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
            if held is not None:  # that row goes first
                cols = [np.concatenate([[h], c]) for h, c in zip(held, cols)]
            token, part, pos, cls = cols[:4]
            start = np.ones(len(token), bool)
            start[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            again = np.zeros(len(token), bool)  # rows of copies
            again[1:] = ~start[1:] & (pos[1:] == pos[:-1]) & (cls[1:] == cls[:-1])
            if held is not None and len(token) > 1 and not start[1]:
                again[1] |= last == (pos[1], cls[1])
            last = pos[-1], cls[-1]
            group = np.cumsum(start) - 1
            whole = np.zeros(len(token), bool)  # all of the group is here, and it was not dealt out
            whole[:] = (part == 0) & (group < group[-1]) & ((group > 0) | (held is None))
            use = ~again & ~(whole & ~partnered(group, again, *cols[2:]))
            several = np.bincount(group, use) > 1
            if held is not None and not waits:
                several[0] = True
            keep = use & (several[group] | (part > 0))
            if held is not None and not waits:
                keep[0] = False  # returned before
            at = np.flatnonzero(start)[-1]
            waits = not (keep[at] or (at == 0 and held is not None and not waits))
            held = [c[at] for c in cols]
            used = np.flatnonzero(use)
            centre = used[np.searchsorted(group[used], group[keep])]  # the group's first row in use
            out = [c[keep] for c in cols] + [c[centre] for c in cols[2:]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.int64(), pa.int32(), pa.int8()]
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip(out, kinds)], names)

    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "cls").mapInArrow(
        central, "token long, part int, pos int, cls long, n int, level byte, p_pos int, p_cls long, p_n int, p_level byte")


def may_link(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Size and position filters of two entries of one token that is among the first l shared."""
    extra = F.least(a["level"], b["level"]) - 1
    rest = F.least(a["n"] - a["pos"], b["n"] - b["pos"]) + extra
    return ((100 * F.least(a["n"], b["n"]) >= PERCENT * F.greatest(a["n"], b["n"]))
            & ((100 + PERCENT) * rest >= PERCENT * (a["n"] + b["n"])))


def entry(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("pos", "cls", "n", "level")}


def pairs_of(rows: DataFrame, a: dict[str, Column], b: dict[str, Column]) -> DataFrame:
    """(u, v, need) of entries of one token that may link."""
    return rows.where((a["cls"] != b["cls"]) & may_link(a, b)).select(
        F.least(a["cls"], b["cls"]).alias("u"), F.greatest(a["cls"], b["cls"]).alias("v"), F.least(a["level"], b["level"]).alias("need"))


def counted(pairs: DataFrame) -> DataFrame:
    """(u, v): pairs of classes with as many shared prefix tokens as the smaller l of both. A token gives a pair once."""
    return (pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"))
            .where("shared >= need").select("u", "v"))


def possible(pairs: DataFrame, sets: DataFrame) -> Kept:
    """The pairs whose histograms leave room for enough shared members; their texts are not looked at yet."""
    one = sets.select("cls", "n", "hist").dropDuplicates(["cls"])

    @F.arrow_udf(T.BooleanType())
    def room(na: pa.Array, x: pa.Array, nb: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, p, b, q in zip(na.to_pylist(), x.to_pylist(), nb.to_pylist(), y.to_pylist()):
            most = most_shared(p, q)
            out.append(most is None or (100 + PERCENT) * most >= PERCENT * (a + b))
        return pa.array(out, pa.bool_())

    side = lambda s: one.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("hist").alias(f"h_{s}"))
    return kept(pairs.join(side("u"), "u").join(side("v"), "v").where(room("n_u", "h_u", "n_v", "h_v")).select("u", "v"))


class Texts:
    """Texts of the classes that occur in candidate pairs, compressed, read from `texts` once for each class."""

    def __init__(self, classes: DataFrame, texts: DataFrame) -> None:
        self.one = kept(classes.groupBy("cls").agg(F.min("doc").alias("doc")))
        self.texts, self.stored = texts, []

    def of(self, pairs: DataFrame) -> DataFrame:
        """(cls, packed, size) of the classes in pairs, and those asked for before."""
        wanted = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()
        for have in self.stored:
            wanted = wanted.join(have.df.select("cls"), "cls", "left_anti")
        one = kept(self.one.df.join(wanted, "cls"))
        bits = min(MOST_BITS, max(16, int(8 * one.df.count()).bit_length()))  # some eight places for each wanted document
        found = bitmap(one.df, F.shiftrightunsigned(F.xxhash64("doc"), 64 - bits), bits)

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = np.flatnonzero(in_bitmap(found, batch.column(2).to_numpy(zero_copy_only=False), bits))
                batch = batch.take(pa.array(some))
                for a, b in texts_of(batch.column(1)):
                    column = batch.column(1).slice(a, b - a)
                    h, at = shingles(column)
                    us = [np.unique(h[at[i]:at[i + 1]]) for i in range(b - a)]
                    raw = [x.as_py() for x in column]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array([class_id(u) if len(u) else None for u in us], pa.int64()),
                         pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()),
                         pa.array([len(x) for x in raw], pa.int64())], ["doc", "cls", "packed", "size"])

        thinned = self.texts.withColumn("h", F.xxhash64("doc")).mapInArrow(picked, "doc long, cls long, packed binary, size long")
        self.stored.append(kept(thinned.join(one.df, ["doc", "cls"]).select("cls", "packed", "size").dropDuplicates(["cls"])))
        one.discard()
        return reduce(DataFrame.unionByName, [x.df for x in self.stored])

    def discard(self) -> None:
        for x in (self.one, *self.stored):
            x.discard()


def verified(pairs: DataFrame, members: DataFrame) -> Kept:
    """The pairs (u, v) whose sets reach the threshold. The text of u travels once for up to FEW of its pairs."""
    many = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / FEW).alias("parts"))
    dealt = kept(pairs.join(many, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("u", "part", "v"))
    left = dealt.df.select("u", "part").distinct().join(members.withColumnRenamed("cls", "u"), "u").withColumn("v", F.lit(None).cast("long"))
    right = dealt.df.join(members.withColumnRenamed("cls", "v"), "v")
    cols = ["u", "part", "v", "packed", "size"]
    rows = left.select(*cols).unionByName(right.select(*cols)).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for batch in batches:
            us, vs, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()
            a = 0
            while a < len(batch):
                b, size = a, 0
                while b < len(batch) and (b == a or size + sizes[b] <= 1 << 22):
                    size += sizes[b]
                    b += 1
                raw = [pa.decompress(batch.column(3)[k].as_py(), sizes[k], codec="zstd", asbytes=True) for k in range(a, b)]
                h, at = shingles(pa.array(raw, pa.binary()))
                out: list[tuple[int, int]] = []
                for k in range(a, b):
                    x = np.unique(h[at[k - a]:at[k - a + 1]])
                    if vs[k] is None:
                        now, mine = us[k], x
                        continue
                    assert us[k] == now
                    both = len(np.intersect1d(mine, x, assume_unique=True))
                    if 100 * both >= PERCENT * (len(mine) + len(x) - both):
                        out.append((us[k], vs[k]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])
                a = b

    links = kept(rows.mapInArrow(compared, "u long, v long"))
    dealt.discard()
    return links


def band(n: Column) -> Column:
    """Sizes of two sets that may link lie in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")


def between(e: DataFrame, roots: DataFrame) -> tuple[Kept, DataFrame]:
    """The placed entries, stored, and (u, v, need) of entries of one token that may link and lie in different components, one of them outside its centre's."""
    root = roots.select("cls", "root")
    placed = e.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    centre = root.select(F.col("cls").alias("p_cls"), F.col("root").alias("centre"))
    first = e.where("part = 0 and cls = p_cls").select("token", "p_cls").unionByName(
        # of a token that was dealt out, one of its parts' centres
        e.where("part > 0").groupBy("token").agg(F.min(F.struct("p_pos", "p_cls")).alias("p")).select("token", "p.p_cls"))
    first = first.join(centre, "p_cls", "left").select("token", F.coalesce("centre", "p_cls").alias("centre"))
    placed = kept(placed.join(first, "token").select("token", "cls", "n", "level", "pos", "root", (F.col("root") != F.col("centre")).alias("out"), band(F.col("n")).alias("band")))
    out = placed.df.where("out").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    out = out.select("token", "band", *[F.col(c).alias(f"a_{c}") for c in ("cls", "n", "level", "pos", "root")])
    # a pair of two that are both outside meets once
    met = out.join(placed.df, ["token", "band"]).where("a_root <> root and (not out or a_cls < cls)")
    return placed, pairs_of(met, entry("a_"), entry(""))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_shingles, component) of every row of `docs`: component is the smallest id reachable by links."""
    texts = docs.select(id_or_least(id_col).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("t"))
    cells = sketch(texts)
    prefixed = kept(prefixes(texts, cells))
    # 1. tokens of several classes
    e = kept(grouped(prefixed.df, cells, hot))
    sets = kept(prefixed.df.select("doc", "cls", "n", "hist"))
    prefixed.discard()
    # 2. star; the centres of a token that was dealt out meet one of them
    star = pairs_of(e.df, entry(""), entry("p_"))
    parts = e.df.where("part > 0 and cls = p_cls").select("token", "pos", "cls", "n", "level")
    one = parts.groupBy("token").agg(F.min(F.struct("pos", "cls", "n", "level")).alias("c")).select("token", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("pos", "cls", "n", "level")])
    star = star.unionByName(pairs_of(parts.join(one, "token"), entry(""), entry("c_")))
    pairs = possible(counted(star), sets.df)
    bodies = Texts(sets.df, texts)
    links = verified(pairs.df, bodies.of(pairs.df))
    pairs.discard()
    # 3. between components
    roots = kept(components(links.df).withColumnRenamed("node", "cls"))
    placed, met = between(e.df, roots.df)
    e.discard()
    pairs = possible(counted(met), sets.df)
    placed.discard()
    more = verified(pairs.df, bodies.of(pairs.df))
    for x in (pairs, roots, bodies):
        x.discard()
    roots = components(links.df.unionByName(more.df))
    # the smallest id of each component, handed out class by class
    least = sets.df.groupBy("cls").agg(F.min("doc").alias("doc"))
    least = least.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = kept(least)
    smallest = least.df.groupBy("root").agg(F.min("doc").alias("component"))
    named = kept(least.df.join(smallest, "root").select("cls", "component"))
    for x in (least, links, more):
        x.discard()
    return sets.df.join(named.df, "cls").select(
        id_or_null("doc").alias("id"), F.col("n").cast("long").alias("n_shingles"), id_or_null("component").alias("component"))
