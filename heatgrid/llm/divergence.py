"""Source divergence audit: how each source of a language departs from the language and from its other sources.

Terms are counted once: tasks return, for each (lang, source, term), occurrences and documents of their
partition, Spark adds them up. A language keeps the terms found in at least `min_docs` of its documents.
Everything after that works on count cells, not on terms:

* A term's smoothed share p depends on its count alone, so terms of one group with equal (group count,
  lang count) are one cell with a multiplicity, and the divergence f is evaluated once for each cell.
* Cells of equal value are merged and ranked by cumulative multiplicity; since each value stands for one
  term at least, the values that reach the ranks asked for are among as many best values. Only their
  terms are looked up, and equal values are expanded in UTF-8 order.
* Two sources are compared by the cells (count here, count there) of the terms that both hold. Terms
  of one side alone, or of none, follow from each side's histogram of counts and the vocabulary's size.

All arithmetic is on integers (decimals where a product may pass 64 bits).

Defined cases: null text, lang and source are ''; every (lang, source) that occurs is a group, also without
terms; a language without kept terms gives pairs of value 0 and no terms; ids are not used, every row is a
document; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.shared import kept

#: ASCII letters and every byte of a character outside ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
CHUNK = 1 << 22
HELD = 400_000


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs), one row each; the empty term counts the group's documents."""

    def terms_of(text: bytes) -> Iterator[list[bytes]]:
        """The terms of a text, in lists of bounded size; no term is cut."""
        at = 0
        while at < len(text):
            to = at + CHUNK
            if to < len(text):
                cut = re.compile(rb"[^A-Za-z\x80-\xff]").search(text, to)
                to = cut.start() if cut else len(text)
            yield TERM.findall(text[at:to].lower())
            at = to

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)
        holds: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in holds.items():
                terms = list(c)
                n = times[lang, source]
                for a in range(0, len(terms), 10_000):
                    some = terms[a:a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                         pa.array([n[t] for t in some], pa.int64()), pa.array([c[t] for t in some], pa.int64())],
                        ["lang", "source", "term", "n", "docs"])
            times.clear()
            holds.clear()

        seen = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                group = lang, source
                n, d = times[group], holds[group]
                found: set[bytes] = {b""}
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    found.update(terms)
                d.update(found)
                seen += len(found)
                if seen > HELD:
                    seen = sum(map(len, holds.values()))  # how many are held, repeats not counted
                    if seen > HELD:
                        yield from flushed()
                        seen = 0
        yield from flushed()

    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = docs.select(text(text_col).cast("binary").alias("t"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)): the smoothed share of a term counted n times."""
    whole = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(v > 0, F.lit(1).cast("long") + F.call_function("div", whole, (total + 2 * v).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); both are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` (every other source) and `term` (the `top` that stand out)."""
    counts = kept(term_counts(docs, text_col, lang_col, source_col))
    terms = counts.df.where("term <> ''")
    lang_terms = terms.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    held = kept(terms.select("lang", "source", "term", "n").join(lang_terms.select("lang", "term", "m"), ["lang", "term"]))
    # groups and languages, with the size of the vocabulary
    vocabulary = held.df.select("lang", "term", "m").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("all"))
    totals = held.df.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = kept(
        counts.df.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"), F.coalesce("all", zero).alias("all"))
        .withColumn("none", share(zero, F.col("total"), F.col("v"))))  # the share of a term the group does not hold
    counts.discard()
    g = groups.df

    # terms: cells (count in the group, count in the language)
    cells = held.df.groupBy("lang", "source", "n", "m").agg(F.count(F.lit(1)).alias("times")).join(g, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("m"), F.col("all"), F.col("v"))
    cells = kept(cells.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", "n", "m", "times", apart(F.col("p"), F.col("q")).alias("value")))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.df.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    values = values.withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("times").over(by_value.rowsBetween(W.unboundedPreceding, -1)), zero)
    values = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value")
    chosen = cells.df.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "m", "value")
    expanded = held.df.join(chosen, ["lang", "source", "n", "m"])
    in_order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    term_part = expanded.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value",
                                F.row_number().over(in_order).alias("rank")).where(F.col("rank") <= top)

    # pairs: cells (count here, count there) of the terms both hold
    x = held.df.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    y = held.df.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    both = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("times"))
    side = lambda s: g.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "total", "none")], "v")
    ga, gb = side("a").withColumnRenamed("source_a", "a"), side("b").withColumnRenamed("source_b", "b").drop("v")
    both = both.join(ga, ["lang", "a"]).join(gb, ["lang", "b"])
    pa_, pb = share(F.col("na"), F.col("total_a"), F.col("v")), share(F.col("nb"), F.col("total_b"), F.col("v"))
    both = both.withColumns({"pa": pa_, "pb": pb})
    none_a, none_b = F.col("none_a"), F.col("none_b")
    rise = apart(F.col("pa"), F.col("pb")) - apart(F.col("pa"), none_b) - apart(none_a, F.col("pb")) + apart(none_a, none_b)
    joint = both.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * rise).alias("joint"))
    # a source's own terms against a group that holds none of them, for every other group of the language
    histogram = kept(held.df.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
                     .join(g.select("lang", "source", "total", "v", "none"), ["lang", "source"])
                     .withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).select("lang", F.col("source").alias("a"), "p", "times", F.col("none").alias("none_a")))
    others = g.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"))
    alone = (histogram.df.join(others, "lang").where("a <> b").groupBy("lang", "a", "b")
             .agg(F.sum(F.col("times") * (apart(F.col("p"), none_b) - apart(none_a, none_b))).alias("alone")))
    every = g.select("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), "v").join(others, "lang").where("a <> b")
    turned = joint.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "joint")
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("other"))
    pairs = (every.join(joint.unionByName(turned), ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
             .join(back, ["lang", "a", "b"], "left"))
    base = F.when(F.col("v") > 0, F.col("v") * apart(none_a, none_b))
    value = sum((F.coalesce(c, zero) for c in (F.col("joint"), F.col("alone"), F.col("other"))), F.coalesce(base, zero))
    ranked = W.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    pair_part = pairs.withColumn("value", value).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", F.row_number().over(ranked).alias("rank"))
    return pair_part.unionByName(term_part)
