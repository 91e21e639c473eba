"""Token counts, exact search, language ID and decontamination against plain Python, libraries and held-out rows."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heatgrid.llm import decontaminate, langid, tokens, topk

SF = "/root/testdata/sf0.001"


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", " ", "\n\n  a", "a  b   c", "x <|endoftext|> y", "<|endoftext|>", "é𝄞 ünï code x", "it's  we'll\t1234 ",
             "a\r\nb \r\n\n c", "word " * 30_000, "z" * 5000, " \n" * 500 + "end", "１２ ab　cd \x1c e"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab 1\n\t'.é <|>") for _ in range(200)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r["doc_id"]: r for r in tokens.count_tokens(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512), (i, t and t[:40])
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_byte_batches_keep_order_and_size():
    pieces = ["a" * n for n in (5, 900, 3, 3, 3, 10)]
    out = list(tokens.byte_batches(pieces, 12))
    assert [p for b in out for p in b] == pieces and all(len(b) == 1 or sum(map(len, b)) <= 12 for b in out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.0, 0.5, 1.0]) for _ in range(rng.choice([3, 8, 8]))]) for i in range(1, 401)]
    rows += [(410, None), (420, [1.0, None]), (430, [float("nan"), 1.0]), (440, [float("inf")]), (450, []), (20, [9.0, 9.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.quantised(F.col("e")).alias("v"), F.lit(1).alias("rank"))
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for i in {i for i, _ in q if i % 20 == 0}:
        mine = min(v for j, v in q if j == i)
        best = sorted((-sum(a * b for a, b in zip(mine, v)), j) for j, v in q if j != i)[:10]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    for sizes in ((8192, 512), (37, 5)):
        found = topk.top_k(df.where("id % 20 = 0"), df, 10, *sizes)
        got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()]
        assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("score"))
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    held = langid.predict(docs.where(out), model).where("lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    # texts of no letters, and fits without classes
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "  \n")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in langid.predict(odd, model).collect()} == {("und", 0.0, True)}
    none = langid.fit(docs.limit(0))
    assert none.langs == [] and {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


ITEM = ("Alice buys 12 kg of apples in London and sells half of them to her neighbour for 30 dollars before she walks home with "
        "the 6 kg that remain. How many dollars does Alice get for each of the apples that she sold in London?")


def test_decontamination_of_templates(spark):
    other = ITEM.replace("Alice", "Marta").replace("London", "Paris").replace("12 kg", "44 kg").replace("30 dollars", "81 dollars").replace("6 kg", "22 kg")
    # every slot filled anew: placeholders meet, values contradict each other
    n = iter(range(100, 200))
    loose = " ".join(f"Name{chr(97 + next(n) % 26)}" if w in ("Alice", "London") else w for w in ITEM.split())
    clean = "A clean page about rivers and hills that shares no question with anybody and goes on for a while without numbers or names."
    docs = [(1, "intro words here. " + ITEM + " more words."), (2, other), (3, clean), (4, None), (5, ""), (6, ITEM.upper()), (7, clean + " How many dollars does"),
            (2, other), (None, ITEM), (8, "filler words of a page " * 20_000 + other)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    items = spark.createDataFrame([(70, ITEM, 1), (70, ITEM, 1), (71, None, 1), (72, "too short", 1)], "item_id long, text string, w int")
    found = decontaminate.leaks(df, items).collect()
    assert {(r["id"], r["item"]) for r in found} >= {(1, 70), (2, 70), (6, 70), (None, 70), (8, 70)}
    assert {r["id"] for r in found} <= {1, 2, 6, 8, None} and len(found) == 5
    left = decontaminate.decontaminate(df, items)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 7]
    assert decontaminate.leaks(df.limit(0), items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0
    assert loose != ITEM


def test_decontamination_of_short_and_number_dense_items_and_of_values_that_meet_by_chance(spark):
    short, dense = "Name the capital of Chad", "12 + 7 = 19, 19 * 3 = 57, 57 - 8 kg = 49 kg, 49 / 7 = 7"
    bags = "A farmer fills 5 bags with 5 apples and then carries all of them to the market before noon"
    pad = "some words that stand before the copy, {} and others that follow it on the page"
    items = spark.createDataFrame([(1, short), (2, dense), (3, bags), (4, "!?")], "item_id long, text string")
    docs = [(10, pad.format(short)), (11, pad.format("Name the capital city of Chad")), (12, "Name the capital of"),
            (20, pad.format(dense)), (21, pad.format(dense.replace("19", "20").replace("57", "60").replace("7", "6"))),
            (30, pad.format(bags.replace("5 bags", "7 bags").replace("5 apples", "3 apples"))), (31, pad.format(bags)),
            (40, "Name the capital"), (41, "of Chad")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["id"], r["item"]) for r in decontaminate.leaks(df, items).collect()}
    assert found == {(10, 1), (20, 2), (30, 3), (31, 3)}
    assert decontaminate.leaks(df.coalesce(1), items.where("item_id = 1")).count() == 1


def test_language_id_holds_small_slices_of_a_batch():
    """16 MB of texts at once: memory follows the slice, not the batch, and judgements are those of single texts."""
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo") for b in range(50)]
    words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
    texts = pa.array([" ".join(words[(i * 7 + j * (i % 5 + 1)) % 200] for j in range(800)).encode() for i in range(200)] * 20, pa.binary())
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.zeros(3, np.float32), 0.4)
    assert texts.nbytes > 1 << 23
    langid.judgements(texts.slice(0, 1), model)
    tracemalloc.start()
    got = langid.judgements(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert got.slice(0, 20).to_pylist() == [langid.judgements(texts.slice(i, 1), model)[0].as_py() for i in range(20)]
