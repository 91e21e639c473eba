"""Line dedup with levelled sorted runs of line hashes.

A run is a stored table (hash of a line's key, id of the document that owns it), sorted by hash.
Batches of documents come in rising id order. A batch first reduces its lines to one row per hash
(combined before rows move), merge-anti-joins the runs, and what is new becomes a run of level 0.
When a level holds `fanout` runs they are merged into one run of the next level, so a hash is
rewritten a logarithmic number of times. The owner of a hash is the smallest id holding it, since
batches rise and a batch takes its minimum.

A line is dropped where its key is owned by another document. Hashes have 128 bits.

Defined cases: null text counts as empty and stays null; empty text is one empty line; a null id is
one document below all others; rows that repeat an id are one document; lines shorter than
`min_chars` code points (after stripping) are never dropped; an empty table gives an empty table;
columns of the input named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.shared import Kept, id_or_least, kept

MIN_CHARS = 10
HASHES = T.ArrayType(T.BinaryType())


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, None where the key is too short to count."""
    key = line.strip()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc): each distinct line key of each row of documents."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {line_key(x, min_chars) for x in text.as_py().split(b"\n")}
                found.discard(None)
                hs.extend(found)
                ids.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc"])

    rows = docs.select(id_or_least(id_col).alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    return rows.mapInArrow(hashes, "h binary, doc long")


class LineRuns:
    """The levelled runs; `add` takes one batch of (h, doc) rows whose ids are above all earlier ones."""

    def __init__(self, fanout: int = 2) -> None:
        self.fanout = fanout
        self.levels: list[list[Kept]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run.df for level in self.levels for run in level]

    def all_rows(self) -> DataFrame | None:
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> None:
        fresh = lines.groupBy("h").agg(F.min("doc").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
        self.levels[0].append(kept(fresh.sortWithinPartitions("h")))
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            both = old[0].df
            for run in old[1:]:
                both = both.unionByName(run.df)
            merged = kept(both.repartition("h").sortWithinPartitions("h"))
            self.levels[level] = []
            for run in old:
                run.discard()
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """(doc, hs): the hashes of the lines each document loses; documents that lose none are left out."""
    lines = kept(line_hashes(docs, id_col, text_col, min_chars))
    cuts = lines.df.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"]
    edges = [None, *sorted(set(cuts or [])), None]
    runs = LineRuns(fanout)
    for low, high in zip(edges, edges[1:]):
        part = lines.df
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        runs.add(part)
    lost = (lines.df.join(runs.all_rows(), "h").where("doc <> owner").select("doc", "h"))
    out = kept(lost.groupBy("doc").agg(F.collect_set("h").alias("hs")))
    lines.discard()
    for level in runs.levels:
        for run in level:
            run.discard()
    return out.df


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    batches: int = 4, fanout: int = 2,
) -> DataFrame:
    """All rows and columns of `docs`, with `text_col` rebuilt from the lines kept, n_lines and n_dropped."""
    lost = dropped_lines(docs, id_col, text_col, min_chars, batches, fanout)

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def rebuild(text: pa.Array, hs: pa.Array) -> pa.Array:
        out, lines_of, dropped_of = [], [], []
        for t, h in zip(text, hs):
            t = t.as_py()
            lines = (t or b"").split(b"\n")
            drop = set(h.as_py() or ())
            keep = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
            out.append(None if t is None else b"\n".join(keep))
            lines_of.append(len(lines))
            dropped_of.append(len(lines) - len(keep))
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64())],
            ["text", "n_lines", "n_dropped"])

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = (docs.select(*[F.col(f"`{c}`") for c in names], id_or_least(id_col).alias("__doc"))
              .join(lost.select(F.col("doc").alias("__doc"), F.col("hs").alias("__hs")), "__doc", "left"))
    done = joined.withColumn("__r", rebuild(F.col(f"`{text_col}`").cast("binary"), F.col("__hs")))
    return done.select(
        *[F.col("__r.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.col("__r.n_lines").alias("n_lines"), F.col("__r.n_dropped").alias("n_dropped"))
