"""Source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

from heatgrid.llm import divergence

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=10, top=10):
    groups, df, count = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UP))
        groups.add((lang, source))
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        mine = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in mine:
            total.update(count[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(total), {s: shares(count[lang, s]) for s in mine}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in mine:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def rows():
    rng = random.Random(8)
    words = [f"{c}{d}" for c in "abcdefgh" for d in "xyzéß"] + ["Über", "日本", "x9y", "É", "A\u0085b", "ﬀ", "\U0001f642", "", "\U00010000"]
    out = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s2", "s", "s\U00010000", None, "S1"])
        skew = rng.randrange(len(words))
        out.append((" ".join(rng.choice([words[skew], rng.choice(words)]) for _ in range(rng.randrange(30))), lang, source))
    return out + [(None, "fr", "only"), ("rare words", "xx", "a"), ("", "xx", "b"), ("z" * 300_000 + " " + "ab cd " * 300_000, "en", "s1")]


def test_against_plain_python(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "t") for r in data], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(data)


def test_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_counts_do_not_wrap(spark):
    """Shares stay exact where SCALE times a count passes 64 bits."""
    from pyspark.sql import functions as F

    n, total = 90_000_000_000, 1_000_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (n + 2) // (total + 14)
