"""Benchmark decontamination by templates.

Tokens are runs of ASCII letters and digits and of bytes from 0x80, so punctuation does not matter.
A text becomes a template: numbers (tokens that begin with a digit), units (a known unit after a
number) and names (a capital followed by no capital) turn into typed placeholders, all else is
lower-cased. Windows of `WINDOW` template tokens with at least `PLAIN` plain ones are hash-joined
with the windows of the benchmark. A second form keeps the words of names, so that a passage in other
capitals is found as well. Windows of the literal tokens (numbers and names kept, no matter how many are
plain) find verbatim copies; an item of fewer than `WINDOW` tokens is one literal window as long as itself,
joined by hash and length.

Matches of a document and an item on one diagonal (document place minus item place) belong together.
Their slots must be consistent: one value of the item goes with one value in the document throughout,
up to `SLACK` of the values, or one where the diagonal matches most of the item's template windows. So a question
with other numbers and names is caught, while a chance meeting of placeholders is not. A document leaks an item
when consistent diagonals match at least half of the item's template windows, or `ENOUGH` of them, or when
literal windows match at least half of the item's literal windows, or `ENOUGH` of them.

A bit set of fixed size over the benchmark's hashes thins the documents' windows before the join; the
join itself is left to the planner, which broadcasts the benchmark only below its size limit.

Defined cases: null texts and texts without a token match nothing; an item of few tokens is found wherever those
tokens stand in a row, so an item of one word is leaked by every document with that word; repeated items or documents count once per id; null ids are one
id; empty tables give no leaks; other columns of the inputs are ignored by `leaks` and kept by `decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.arrays import batch_bytes, inside, mix, spans, texts_of, window_hashes, word_names
from heatgrid.llm.shared import bitmap, high_bits, id_or_least, id_or_null, in_bitmap, kept

WINDOW = 8
PLAIN = 4
ENOUGH = 6
SLACK = 0.2
BITS = 22
UNITS = ("kg g mg lb lbs oz t km m cm mm mi mile miles yard yards foot feet ft inch inches l ml liter liters litre litres "
         "gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
         "dollar dollars euro euros cent cents pound pounds percent degree degrees mph kmh kph kb mb gb tb hz khz mhz ghz "
         "v volt volts w watt watts kw kwh j joule joules n newton newtons pa mol").split()
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NUM, NAME, UNIT = (np.uint64(x) for x in (0x6E756D62, 0x6E616D65, 0x756E6974))


def names_of_words(words: list[str]) -> np.ndarray:
    data, offsets = batch_bytes(pa.array([w.encode() for w in words], pa.binary()))
    starts, ends, _ = spans(data, offsets, IS_TOKEN)
    return word_names(data, starts, ends, lower=True)


def template(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with names typed, symbols with names kept, values) of the tokens of a slice of texts."""
    values = word_names(data, starts, ends, lower=True)
    first = data[starts]
    second = data[np.minimum(starts + 1, ends - 1)]
    number = (first >= 48) & (first <= 57)
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & (ends - starts > 1) & ~((second >= 65) & (second <= 90))
    unit = np.zeros(len(values), bool)
    unit[1:] = number[:-1]
    unit[at[:-1][at[:-1] < len(unit)]] = False
    unit &= np.isin(values, names_of_words(UNITS))
    kept_names = np.where(number, NUM, np.where(unit, UNIT, values))
    return np.where(name & ~unit, NAME, kept_names), kept_names, values


def windows(texts: DataFrame, found: np.ndarray | None, bits: int = BITS, short: Sequence[int] = range(1, WINDOW)) -> DataFrame:
    """(id, pos, size, w, slots) of rows (id, t): the windows whose hash is in the bit set `found`, or all.

    `size` is 0 for template windows and the number of tokens for literal ones. Literal windows of the
    sizes `short` are taken anywhere in a text; without `found` only where they are the whole text.
    """
    literal_sizes = [*short, WINDOW]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in texts_of(batch.column(1)):
                data, offsets = batch_bytes(batch.column(1).slice(a, b - a))
                starts, ends, at = spans(data, offsets, IS_TOKEN)
                typed, literal, values = template(data, starts, ends, at)
                out_id, out_pos, out_size, out_w, out_slots = [], [], [], [], []
                for seed, symbols, size in ((1, typed, WINDOW), (2, literal, WINDOW), *((3, values, k) for k in literal_sizes)):
                    w = mix(window_hashes(symbols, size) + np.uint64(seed))
                    good = inside(at, size)
                    if seed == 3:
                        slot = np.zeros(len(symbols), bool)
                        if found is None and size < WINDOW and len(w):
                            whole = at[:-1][np.diff(at) == size]
                            good = np.zeros(len(w), bool)
                            good[whole] = True
                    else:
                        slot = (symbols == NUM) | (symbols == NAME) | (symbols == UNIT)
                        plain = np.concatenate([[0], np.cumsum(~slot)])
                        if len(w):
                            good &= plain[WINDOW:] - plain[:-WINDOW] >= PLAIN
                    if found is not None and len(w):
                        good &= in_bitmap(found, w, bits)
                    pos = np.flatnonzero(good)
                    text = np.searchsorted(at, pos, side="right") - 1
                    out_id.append(ids[a:b][text])
                    out_pos.append(pos - at[text])
                    out_size.append(np.full(len(pos), size if seed == 3 else 0))
                    out_w.append(w[pos])
                    out_slots += [values[p:p + size][slot[p:p + size]].view(np.int64) for p in pos]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_id).astype(np.int64)), pa.array(np.concatenate(out_pos).astype(np.int32)),
                     pa.array(np.concatenate(out_size).astype(np.int32)), pa.array(np.concatenate(out_w).view(np.int64)), pa.array(out_slots, pa.list_(pa.int64()))],
                    ["id", "pos", "size", "w", "slots"])

    return texts.mapInArrow(rows, "id long, pos int, size int, w long, slots array<long>")


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item, n_matched, n_windows, n_slots): the items each document leaks; one row per pair."""
    t = F.col(f"`{item_text_col}`").cast("binary")
    bench = items.select(id_or_least(item_col).alias("id"), t.alias("t")).where("t is not null")
    bench = kept(windows(bench, None).select(F.col("id").alias("item"), F.col("pos").alias("ipos"), "size", "w", F.col("slots").alias("islots")).distinct()).df
    short = sorted(r["size"] for r in bench.select("size").where(F.col("size").between(1, WINDOW - 1)).distinct().collect())
    found = bitmap(bench, high_bits("w", BITS), BITS)
    t = F.col(f"`{text_col}`").cast("binary")
    mine = windows(docs.select(id_or_least(id_col).alias("id"), t.alias("t")).where("t is not null"), found, short=short)
    hits = mine.join(bench, ["w", "size"])
    typed = F.col("size") == 0
    sizes = bench.groupBy("item").agg(
        F.count_distinct("ipos").alias("n_windows"), F.count_distinct(F.when(typed, F.col("ipos"))).alias("n_typed"),
        F.count_distinct(F.when(~typed, F.col("ipos"))).alias("n_literal"))
    diagonals = hits.groupBy("id", "item", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
        F.collect_set(F.when(typed, F.col("ipos"))).alias("at"), F.collect_set(F.when(~typed, F.col("ipos"))).alias("literal_at"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("islots", "slots")))).alias("slots"))
    # a value of the item that goes with several values in the document is inconsistent
    distinct = F.size(F.array_distinct(F.transform("slots", lambda s: s["islots"])))
    slack = F.greatest(SLACK * distinct, (2 * F.size("at") > F.col("n_typed")).cast("int"))
    steady = F.size("slots") - distinct <= slack

    def places(*names):
        return F.size(F.array_distinct(F.flatten(F.concat(*[F.collect_list(x) for x in names]))))

    matched = diagonals.join(sizes, "item").withColumn("at", F.when(steady, F.col("at")).otherwise(F.slice("at", 1, 0))).groupBy("id", "item").agg(
        places("at").alias("typed"), places("literal_at").alias("literal"), places("at", "literal_at").alias("n_matched"),
        F.coalesce(F.max(F.when(steady, F.size("slots"))), F.lit(0)).alias("n_slots"), *[F.first(x).alias(x) for x in ("n_windows", "n_typed", "n_literal")])

    def leaked(n, of):
        return (F.col(n) > 0) & (F.col(n) >= F.least(F.ceil(F.col(of) / 2), F.lit(ENOUGH)))

    return matched.where(leaked("typed", "n_typed") | leaked("literal", "n_literal")).select(
        id_or_null("id").alias("id"), id_or_null("item").alias("item"), F.col("n_matched").cast("long"), "n_windows", F.col("n_slots").cast("long"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = kept(leaks(docs, items, id_col, text_col).select(id_or_least("id").alias("__doc")).distinct()).df
    return docs.withColumn("__doc", id_or_least(id_col)).join(bad, "__doc", "left_anti").drop("__doc")
