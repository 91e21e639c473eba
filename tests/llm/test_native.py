"""Personal data, urls and mixing against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from heatgrid.llm import mixing, pii, urls

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(d) <= 15
    return True


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text or "") if good(k, m[0]))


TEXTS = [
    None, "", "no data", "é𝄞 a.b@c.d_e@f.gh x", "a@b", "@a.b", "x..y@z.co.uk, a@b-c.d-e.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 999999999999.1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111 11111111  4", "+1 (743) 555-3824 + 1 +12 +123456789012345678 +1-2-3-4-5-6-7-8-",
    "9" * 5000 + "." + "a" * 20000 + "@", "IBAN DE89 3704 0044 0532 0130 00 paid; DE88370400440532013000", "my ssn 123-45-6789 or 123-45-6789",
    "mail éé you@x.org " * 300, "1.1.1.1 " * 2000, "part no. " + "4" * 100 + " 123-45-6789"]


def test_pii_matches_plain_regular_expressions(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(TEXTS):
        want = base_spans(t)
        assert rows[i]["base_spans"] == want, (i, t and t[:50])
        assert rows[i]["n_ip"] == want.count("ip:") and rows[i]["n_email"] == want.count("email:")
        assert rows[i]["spans"].startswith(want)
    assert rows[11]["spans"] == "iban:5:32" and "ssn" in rows[12]["spans"]
    assert "ssn" not in rows[15]["spans"]


def test_pii_of_a_text_with_very_many_matches(spark):
    """Positions and counts of 100,000 matches in one text; the work grows with their number, not with its square."""
    import time

    n, unit = 100_000, "é 10.0.0.1, "
    df = spark.createDataFrame([(1, unit * n + "mail a@b.cd"), (2, "host 10.0.0.1")], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert time.time() - began < 120
    spans = rows[1]["base_spans"].split(",")
    assert (rows[1]["n_ip"], rows[1]["n_email"], len(spans)) == (n, 1, n + 1)
    assert spans[0] == f"email:{len(unit) * n + 5}:{len(unit) * n + 11}"
    assert all(spans[1 + k] == f"ip:{len(unit) * k + 2}:{len(unit) * k + 10}" for k in range(n))


def test_pii_context_over_neighbours_and_own_columns(spark):
    """Context words that stand in a neighbouring match or beyond it, up to 40 code points away; columns named like ours."""
    texts = ["host@x.yy 1.1.1.1 2.2.2.2", "address " + "x" * 31 + " 1.2.3.4", "address " + "x" * 33 + " 1.2.3.4", "1.2.3.4 9.9.9.9 8.8.8.8 7.7.7.7 server",
             "1.2.3.4 " + "y" * 34 + " server", "1.2.3.4 " + "y" * 30 + " server"]
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, pii_email string, __p_ip int")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert all(r["pii_email"] == "own" and r["__p_ip"] == 5 for r in got.values())
    kind = next(k for k in pii.KINDS if k.name == "ip")
    for i, t in enumerate(texts):
        want = []
        for m in re.finditer(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", t):
            near = t[max(0, m.start() - 40):m.start()] + "\n" + t[m.end():m.end() + 40]
            want.append(f"ip:{m.start()}:{0.8 if re.search(kind.context, near.lower()) else 0.6}")
        assert [s for s in got[i]["scores"].split(",") if s.startswith("ip")] == want, t


def test_pii_context_raises_the_score(spark):
    df = spark.createDataFrame([(1, "my card 4111 1111 1111 1111"), (2, "lot 4111 1111 1111 1111")], "doc_id long, text string")
    got = {r["doc_id"]: r["scores"] for r in pii.find_pii(df).collect()}
    assert got == {1: "card:8:1.0", 2: "card:4:0.8"}


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@pytest.mark.parametrize("url,host,path,rule", [
    (None, "", "", None), ("no scheme", "", "", None), ("", "", "", None), ("http://A.Com", "a.com", "", None),
    ("http://É.Com/x?y#z", "É.com", "/x", "com/"), ("x://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
    ("x://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"), ("x://m.example.com/en/?", "m.example.com", "/en/", "example.com/en/"),
    ("x://example.com/EN/", "example.com", "/EN/", "com/"), ("x://notcom/a", "notcom", "/a", None), ("a://b.net#/es/", "b.net", "", None),
    ("a://b.net/es/://c", "b.net", "/es/://c", "net/es/"), ("://x.net/fr/", "x.net", "/fr/", "net/fr/")])
def test_url_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, "keep")], "page_id long, url string, other string")
    r = urls.filter_urls(df, RULES, 0.0).first()
    assert (r["host"], r["path"], r["rule"], r["other"]) == (host, path, rule, "keep")
    assert r["verdict"] == (dict((b, a) for a, b in RULES)[rule] if rule else "allow")


def test_url_model_learns_the_labels(spark):
    rows = [(f"http://spam-farm{i}.org/win/{i}", 1) for i in range(40)] + [(f"http://library{i}.org/books/{i}", 0) for i in range(40)]
    labelled = spark.createDataFrame([*rows, (None, 0), ("", None)], "url string, label int")
    model = urls.fit(labelled)
    new = spark.createDataFrame([("http://spam-farm99.org/win/7",), ("http://library99.org/books/3",), (None,)], "url string")
    assert [r["verdict"] for r in urls.filter_urls(new, (), model).collect()][:2] == ["block", "allow"]
    assert urls.fit(labelled.where("label = 1")) == 1.0 and urls.fit(labelled.limit(0)) == 0.0


def targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * total - sum(2 * sizes[s] for s in full)
        wsum = sum(w[s] for s in names if s not in full)
        t = {s: 2 * sizes[s] if s in full else left * w[s] / wsum for s in names}
        over = {s for s in names if s not in full and t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix_comes_near_its_targets(spark):
    docs = [(i, "w " * (1 + i * 37 % 400), ["b", "a", "a", "a", None, "ç"][i % 6], "x") for i in range(1200)]
    docs += [(5000, None, "a", "x"), (5001, "", "zero", "x"), (None, "two words", "b", "x"), (7, "again here", "b", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, taken string")
    got = mixing.mix_sources(df, shard_words=4096).collect()
    again = mixing.mix_sources(df.repartition(5), shard_words=4096).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(docs)
    size = {}
    for _, t, s, _ in docs:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = targets(size)
    for s in size:
        mine = [r for r in got if abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == size[s]]
        took = sum(r["taken"] for r in mine)
        assert abs(took - want[s]) <= 0.01 * want[s] + 1, (s, took, want[s])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def taken_by_source(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    source = {i: s for i, _, s in docs}
    size, took = {}, {}
    for r in mixing.mix_sources(df, **options).collect():
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[s], took[s] = r["source_size"], took.get(s, 0) + r["taken"]
    want = targets(size)
    return {s: (want[s], took[s]) for s in size}


def test_mix_of_small_sources(spark):
    """A source of a few words beside a large one, as whole texts and as texts of one word."""
    small = [1, 2, 3, 5, 10, 20, 30, 40, 50, 60, 80, 100, 120, 150, 200]
    docs = [(i, "w " * 500, "big") for i in range(40)]
    docs += [(100 + i, "w " * n, f"s{i:02}") for i, n in enumerate(small)]
    docs += [(1000 * (1 + i) + k, "w", f"t{i:02}") for i, n in enumerate(small) for k in range(n)]
    for s, (want, took) in taken_by_source(spark, docs).items():
        assert abs(took - want) <= 0.05 * want, (s, want, took)


def test_mix_of_many_sources(spark):
    docs = [(i * 3 + k, "w " * (40 + (i * 7 + k * 13) % 41), f"s{i}") for i in range(2000) for k in range(3)]
    found = taken_by_source(spark, docs)
    assert max(abs(took - want) / want for want, took in found.values()) <= 0.05
    assert abs(sum(t for _, t in found.values()) / sum(w for w, _ in found.values()) - 1) < 0.01


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0
    words = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(words).collect()] == [(0, 0.0, 0)] * 2


def test_apportion_takes_the_highest_quotients(spark):
    import random

    rng = random.Random(3)
    for n, k in ((0, 3), (1, 4), (7, 5), (100, 6), (12345, 9)):
        w = [rng.choice([0, 1, 5, 100, 3.7]) for _ in range(k)]
        if not any(w):
            w[0] = 1
        seats = [0] * k
        for _ in range(n):
            best = max(range(k), key=lambda i: (w[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(w)], "g int, i int, w double")
        got = mixing.apportion(df, ["g"], "i", "w", F.lit(n), "s").orderBy("i").collect()
        assert sum(r["s"] for r in got) == n
        assert [r["s"] for r in got] == seats, (n, w)


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
