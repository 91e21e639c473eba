"""Substring dedup by recompression: words covered by a long window seen earlier are removed.

A round of recompression names things so that equal substrings get equal names away from their ends.
Token runs: a token that repeats the one before it gets the name of its run's body. Pairs: a hash bit
of the round puts every symbol left or right, and a left symbol followed by a right one becomes one
symbol named by both. Names are hashes of what they stand for, hence the same in every task, and a round
moves no rows. A symbol of level k spans at most 2**k words, and where it begins depends on a few
words around that place alone.

Places where a symbol of level 3 begins are thus found alike in equal passages. Such a place is named by
its two neighbouring symbols of level 2 and the `LEFT + RIGHT` words around it, since two symbols alone may
span so few words that they meet by chance. Each window of `WINDOW` words takes the least name of the places
in its inside as its key. Equal windows have equal keys, and a key is shared by about seven windows in a row.

0. Rows whose whole word sequence a smaller id holds share the topmost symbol, its name being the hash of all
   words (128 bits). They lose every word, and need not be looked at again: what they hold begins earlier.
1. Spark counts keys by document and keeps those of two documents or more: shared symbols reveal
   the passages that may repeat.
2. Only windows with such a key are looked at again, once per document; their hash together with the
   key (128 bits) verifies the repeat, and the smallest id holding one is its first place.
3. Another document drops the words of its windows whose first place is a smaller id, or which began earlier
   in itself.

Defined cases: null text has no words (and stays null); texts shorter than a window lose nothing; kept words are
joined by one space; a null id is one id below all others; rows that repeat an id are not earlier than
one another, each loses only what smaller ids or its own earlier words hold; an empty table gives an
empty table; columns of the input named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.arrays import BASE, batch_bytes, mix, spans, texts_of, window_hashes, word_names
from heatgrid.llm.shared import bitmap, id_or_least, in_bitmap, kept

WINDOW = 20
LEFT, RIGHT = 5, 4  # words before and after a place on which its key may depend
NONE = np.uint64((1 << 64) - 1)
DOC_BITS = 23
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def round_of(sym: np.ndarray, seed: int) -> np.ndarray:
    """True where a symbol stands on the left in the round."""
    return mix(sym + mix(np.array([seed], np.uint64))) >> np.uint64(63) == 0


def symbols(names: np.ndarray, at: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, word each begins at, marks of those that begin a text) after some rounds."""
    first = np.zeros(len(names) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    sym, begin = names.copy(), np.arange(len(names))
    body = np.zeros(len(names), bool)
    body[1:] = (names[1:] == names[:-1]) & ~first[1:]
    sym[body] = mix(names[body] + OTHER)
    for k in range(1, rounds + 1):
        left = round_of(sym, k)
        pair = left[:-1] & ~left[1:] & ~first[1:]
        i = np.flatnonzero(pair)
        sym[i] = mix(sym[i] * BASE + sym[i + 1] * OTHER + np.uint64(k))
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, begin, first = sym[keep], begin[keep], first[keep]
    return sym, begin, first


def window_keys(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Key of the window at each place of the flat words (windows over a text's end hold nonsense)."""
    n = len(names) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sym, begin, first = symbols(names, at)
    left = round_of(sym, 3)
    starts = ~(left[:-1] & ~left[1:]) & ~first[1:]  # the next round does not join the two
    i = np.flatnonzero(starts) + 1
    around = window_hashes(names, LEFT + RIGHT)
    i = i[(begin[i] >= LEFT) & (begin[i] - LEFT < len(around))]
    value = np.full(len(names), NONE)
    value[begin[i]] = mix(sym[i - 1] * BASE + sym[i] * OTHER + around[begin[i] - LEFT]) >> np.uint64(1)
    span = WINDOW - LEFT - RIGHT + 1
    least, size = value, 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return least[LEFT:LEFT + n]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = batch_bytes(column)
    starts, ends, at = spans(data, offsets)
    return word_names(data, starts, ends), at


def whole_name(names: np.ndarray) -> bytes:
    """Name of a text's whole word sequence."""
    return xxhash.xxh3_128_digest(names.tobytes())


def document_keys(texts: DataFrame) -> DataFrame:
    """(doc, whole, keys): each row (doc, t) of at least a window: its whole sequence's name, its distinct window keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in texts_of(batch.column(1)):
                names, at = words_of(batch.column(1).slice(a, b - a))
                keys = window_keys(names, at)
                some = np.flatnonzero(np.diff(at) >= WINDOW)
                whole = [whole_name(names[at[i]:at[i + 1]]) for i in some]
                out = [np.unique(keys[at[i]:at[i + 1] - WINDOW + 1]).view(np.int64) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(whole, pa.binary()),
                     pa.array(out, pa.list_(pa.int64()))], ["doc", "whole", "keys"])

    return texts.mapInArrow(rows, "doc long, whole binary, keys array<long>")


def later_copies(keys: DataFrame) -> DataFrame:
    """(doc, whole) of the rows whose whole word sequence a smaller id holds."""
    first = keys.groupBy("whole").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi")
    first = kept(first.select("whole", "lo"))
    out = kept(keys.select("doc", "whole").join(first.df, "whole").where("doc <> lo").select("doc", "whole"))
    first.discard()
    return out.df


def packed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, z): compressed texts of about the documents wanted, thinned by a bit set of fixed size."""
    found = bitmap(wanted, F.shiftrightunsigned(F.xxhash64("doc"), 64 - DOC_BITS), DOC_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            some = np.flatnonzero(in_bitmap(found, batch.column(2).to_numpy(zero_copy_only=False), DOC_BITS))
            batch = batch.take(pa.array(some))
            z = [pack(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc", "z"])

    return texts.withColumn("h", F.xxhash64("doc")).mapInArrow(rows, "doc long, z binary")


def candidate_windows(rows: DataFrame) -> DataFrame:
    """(w, key, doc) of rows (doc, z, keys): the distinct windows of each document that have one of the keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = zstandard.ZstdDecompressor().decompress
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                texts = pa.array([unpack(z.as_py()) for z in batch.column(1).slice(lo, hi - lo)], pa.binary())
                for a, b in texts_of(texts):
                    names, at = words_of(texts.slice(a, b - a))
                    keys, w = window_keys(names, at), window_hashes(names, WINDOW)
                    out_w, out_k, out_n = [], [], []
                    for i in range(b - a):
                        mine = slice(at[i], max(at[i], at[i + 1] - WINDOW + 1))
                        shared = batch.column(2)[lo + a + i].values.to_numpy(zero_copy_only=False)
                        some = np.flatnonzero(np.isin(keys[mine].view(np.int64), shared))
                        # in the order of the text, where a key stands several times in a row: this is stored small
                        some = some[np.sort(np.unique(w[mine][some], return_index=True)[1])]
                        out_w.append(w[mine][some].view(np.int64))
                        out_k.append(keys[mine][some].view(np.int64))
                        out_n.append(len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_w)), pa.array(np.concatenate(out_k)),
                         pa.array(np.repeat(docs[lo + a:lo + b], out_n))], ["w", "key", "doc"])

    return rows.mapInArrow(of, "w long, key long, doc long")


def earlier_windows(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, ws): the windows of each document that a smaller id holds, as hashes; (doc, wholes): its texts that are later copies."""
    keys = kept(document_keys(texts))
    copies = later_copies(keys.df)
    each = keys.df.join(copies, ["doc", "whole"], "left_anti").select("doc", F.explode("keys").alias("key"))
    shared = kept(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key"))
    wanted = kept(each.join(shared.df, "key").groupBy("doc").agg(F.collect_set("key").alias("keys")))
    keys.discard()
    shared.discard()
    windows = kept(candidate_windows(packed(texts, wanted.df).join(wanted.df, "doc")))
    wanted.discard()
    first = kept(windows.df.groupBy("w", "key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("w", "key", "lo"))
    late = windows.df.join(first.df, ["w", "key"]).where("doc <> lo")
    out = kept(late.groupBy("doc").agg(F.collect_list("w").alias("ws")))
    windows.discard()
    first.discard()
    return out.df, copies.groupBy("doc").agg(F.collect_set("whole").alias("wholes"))


def covered(names: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Marks the words of one text covered by a window among `late` or begun earlier in the text."""
    w = window_hashes(names, WINDOW)
    if not len(w):
        return np.zeros(len(names), bool)
    again = np.ones(len(w), bool)
    again[np.unique(w, return_index=True)[1]] = False
    bad = np.flatnonzero(again | np.isin(w.view(np.int64), late))
    edge = np.zeros(len(names) + 1, np.int64)
    edge[bad] += 1
    edge[bad + WINDOW] -= 1
    return np.cumsum(edge)[:-1] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with `text_col` made of the words kept, n_words and n_removed."""
    texts = docs.select(id_or_least(id_col).alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    late, copies = earlier_windows(texts)

    @F.arrow_udf("struct<text:string,n_words:bigint,n_removed:bigint>")
    def rebuild(column: pa.Array, lists: pa.Array, wholes: pa.Array) -> pa.Array:
        out, n_words, n_removed = [], [], []
        full = column.fill_null(b"")
        for a, b in texts_of(full):
            part = full.slice(a, b - a)
            names, at = words_of(part)
            for i in range(b - a):
                mine = names[at[i]:at[i + 1]]
                ws, copied = lists[a + i], wholes[a + i]
                if copied.is_valid and whole_name(mine) in copied.as_py():
                    gone = np.ones(len(mine), bool)
                else:
                    gone = covered(mine, ws.values.to_numpy(zero_copy_only=False) if ws.is_valid else np.empty(0, np.int64))
                words = part[i].as_py().split()
                if gone.any():
                    words = [words[j] for j in np.flatnonzero(~gone)]
                out.append(b" ".join(words) if column[a + i].is_valid else None)
                n_words.append(len(mine))
                n_removed.append(int(gone.sum()))
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            ["text", "n_words", "n_removed"])

    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    joined = (docs.select(*[F.col(f"`{c}`") for c in names], id_or_least(id_col).alias("__doc"))
              .join(late.select(F.col("doc").alias("__doc"), F.col("ws").alias("__ws")), "__doc", "left")
              .join(copies.select(F.col("doc").alias("__doc"), F.col("wholes").alias("__wholes")), "__doc", "left"))
    done = joined.withColumn("__r", rebuild(F.col(f"`{text_col}`").cast("binary"), F.col("__ws"), F.col("__wholes")))
    return done.select(
        *[F.col("__r.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.col("__r.n_words").alias("n_words"), F.col("__r.n_removed").alias("n_removed"))
