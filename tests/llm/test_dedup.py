"""Line dedup, n-gram join and substring dedup against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from heatgrid.llm import lines, ngram_join, recompress

WORDS = re.compile("[^\x20\x09-\x0d]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def corpus(seed=5):
    """Near copies of a text, shared passages, runs, repeats within a text, odd white space, extremes."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    out, base, passage = [], text(160), text(45)
    for i in range(40):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = f"x{rng.random()}"
        out.append(" ".join(t))
    for i in range(40):
        t = text(rng.randrange(1, 90))
        cut = rng.randrange(len(t))
        out.append(" ".join(t[:cut] + passage[rng.randrange(8):] + t[cut:]))
    for i in range(20):
        out.append("\n".join([" ".join(text(6)), " Common LINE of the site ", "short", " ".join(base[10 * i % 50:10 * i % 50 + 9])]))
    out += ["a " * 300, "b " + "a " * 120 + "c", "a b " * 100, "x y z " * 40 + "q", " ".join(base + base), base[0], "É É É", "é é é",
            " \t\x0b\x0c\r ", "", "\n\n", "One\x1ctwo three\x85four\tfive", " ".join(text(3)), "same three words", "SAME three\twords",
            " ".join(f"u{i}" for i in range(60_000)), "z" * 200_000]
    return out


def rows_of(extra=()):
    texts = corpus()
    rows = [(i * 3 + 1, t, "c") for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    return rows + [(100_000, None, None), (100_001, texts[0], "c"), *extra]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry the names the operators use inside or return."""
    df = spark.createDataFrame(rows_of(), "doc_id long, text string, n_dropped string").repartition(5)
    return df.withColumns({"h": F.lit("h"), "doc": F.lit("d"), "n_removed": F.lit("r"), "__x": F.lit(1)}).cache()


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_lines(docs):
    owner, rows = {}, {i: (t or "").split("\n") for i, t, _ in rows_of()}

    def key(line):
        return line.strip(SPACE).translate(UP)

    for i in sorted(rows):
        for x in rows[i]:
            if len(key(x)) >= 10:
                owner.setdefault(key(x), i)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, batches=3).collect()}
    assert len(got) == len(rows)
    for i, ls in rows.items():
        kept = [x for x in ls if owner.get(key(x), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(ls), len(ls) - len(kept)), i
        assert (got[i]["text"] or "") == "\n".join(kept) and got[i]["h"] == "h"
    assert got[100_000]["text"] is None


def test_line_runs_compact(spark):
    runs = lines.LineRuns(fanout=2)
    for batch in range(5):
        df = spark.createDataFrame([(bytes([x]), batch * 10 + x % 3) for x in range(batch * 4, batch * 4 + 8)], "h binary, doc long")
        runs.add(df)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {bytes(r["h"])[0]: r["owner"] for r in runs.all_rows().collect()}
    assert len(got) == 24 and all(got[x] == (x // 4 - (1 if x >= 4 else 0)) * 10 + x % 3 for x in range(24) if x < 20)


def linked_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = WORDS.findall((t or "").translate(UP))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("hot", [ngram_join.HOT, 6])
def test_ngram_join(docs, hot):
    """Also with tokens dealt to several tasks."""
    want = linked_components(rows_of())
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_components(docs, hot=hot).collect()}
    assert got == want


def test_ngram_join_chains_and_sizes(spark):
    """Chains whose ends do not link, and links at exactly 0.8, found although no pivot meets both."""
    rng = random.Random(9)
    rows, n = [], 0
    for group in range(12):
        t = [f"g{group}w{i}" for i in range(rng.choice([12, 40, 90]))]
        for step in range(8):
            n += 1
            rows.append((n * 7 % 1009, " ".join(t), "c"))
            t = t[1 + step % 3:] + [f"g{group}n{n}x{j}" for j in range(1 + step % 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    for hot in (ngram_join.HOT, 3):
        got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_components(df, hot=hot).collect()}
        assert got == linked_components(rows)


def test_ngram_join_groups_over_batches(spark):
    """A template that many unlinked texts share, copies of them, and groups that span Arrow batches."""
    rng = random.Random(3)
    stem, rows = [f"s{i}" for i in range(30)], []
    for i in range(300):
        own = [f"o{i}x{j}" for j in range(rng.choice([12, 14, 60]))]
        rows += [(3 * i + k, " ".join(stem + own[:len(own) - k % 2]), "c") for k in range(rng.choice([1, 1, 2, 3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for hot in (ngram_join.HOT, 50):
            got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.jaccard_components(df, hot=hot).collect()}
            assert got == linked_components(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def removed(rows):
    seen, out = {}, {}
    texts = {i: WORDS.findall(t or "") for i, t, _ in rows}
    for i in sorted(texts):
        w, gone = texts[i], [False] * len(texts[i])
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone[s:s + 20] = [True] * 20
            seen.setdefault(k, (i, s))
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings(docs):
    want = removed(rows_of())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"] or "") for r in recompress.dedup_substrings(docs).collect()}
    assert got == want


def test_substrings_of_repeated_ids(spark):
    """One row of an id is a later copy, the other is not; equal rows of one id are not earlier than one another."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, " " + a), (5, b), (5, b), (7, b + " tail"), (8, "short text"), (9, "short text"), (None, "x " + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["text"]) for r in recompress.dedup_substrings(df).collect())
    assert got == [(0, 0, "x " + b), (3, 0, a), (5, 30, ""), (5, 30, ""), (5, 30, ""), (7, 30, "tail"), (8, 0, "short text"), (9, 0, "short text")]


def test_equal_windows_have_equal_keys():
    import numpy as np

    rng = np.random.default_rng(1)
    for vocab in (2, 3, 10, 1000):
        pool = rng.integers(1, 1 << 62, vocab).astype(np.uint64)
        names = pool[rng.integers(0, vocab, 4000)]
        w = names[1000:1020]
        for place in (0, 57, 2000, 3980):
            names[place:place + 20] = w
        at = np.array([0, 1500, 4000])
        keys = recompress.window_keys(names, at)
        mine = [keys[p] for p in (0, 57, 1000, 2000, 3980)]
        assert len(set(mine)) == 1 and mine[0] != recompress.NONE


def test_empty_and_null_rows(spark):
    for rows in ([], [(None, None, None)], [(None, "a line of some length\nx", None), (1, "a line of some length", "y"), (1, "a line of some length", "y")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert lines.dedup_lines(df).count() == len(rows)
        assert recompress.dedup_substrings(df).count() == len(rows)
        found = ngram_join.jaccard_components(df).collect()
        assert len(found) == len(rows)
    # one shingle against two of which it is one: 0.5, no link; the rows of the repeated id are one text
    assert sorted((r["id"] or 0, r["component"] or 0) for r in found) == [(0, 0), (1, 1), (1, 1)]
