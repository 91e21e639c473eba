"""The pipeline stage by stage over a small corpus: plain Python where a stage has such a form, planted cases where not."""

import random

import pytest

import corpus_pipeline as P
from test_dedup import SPACE, UP, linked_components

LETTERS = {"aa": "bcdaeio", "zz": "xyzquwk"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two languages that share no letters, copies, a line of many documents, a benchmark passage, odd rows."""
    rng = random.Random(11)
    vocab = {lang: ["".join(rng.choice(x) for _ in range(rng.randrange(3, 9))) for _ in range(300)] for lang, x in LETTERS.items()}
    rows = []
    for i in range(240):
        lang = ("aa", "zz")[i % 2]
        ls = [" ".join(rng.choice(vocab[lang]) for _ in range(12)) for _ in range(4)]
        rows.append([i, ls, lang, "web" if i % 3 else None])
    for r in rows[::5]:
        r[1].append(" A line that Many documents hold ")
    for r in rows[10:14]:
        r[1] = [*rows[2][1][:3], rows[2][1][3] + f" b{r[0]}"]
    item = " ".join(rng.choice(vocab["aa"]) for _ in range(40))
    rows[20][1].append(item)
    rows = [(i, "\n".join(ls), lang, source, 1) for i, ls, lang, source in rows]
    rows += [(900, None, None, None, None), (901, "", "aa", "web", 0), (902, "12 34 !?", None, "web", 8), (None, rows[3][1], "zz", "web", 1)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_in_order(spark, tables):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    stages, docs = dict(P.STAGES), spark.read.parquet(f"{tables}/documents.parquet")

    told = stages["language_id"](spark, docs, tables).cache()
    assert tuple(told.columns) == P.COLUMNS
    gone = {r[0] for r in docs.collect()} - {r[0] for r in told.collect()}
    assert {900, 901, 902} <= gone and len(gone) <= 6  # clean documents stay

    lined = stages["line_dedup"](spark, told, tables).cache()
    owner, want = {}, {}
    old = {r["doc_id"]: (r["text"], r["n_chars"]) for r in told.collect()}
    for i in sorted(old, key=lambda x: (x is not None, x)):
        keep = []
        for x in old[i][0].split("\n"):
            key = x.strip(SPACE).translate(UP)
            if len(key) < 10 or owner.setdefault(key, ("id", i)) == ("id", i):
                keep.append(x)
        text = "\n".join(keep)
        want[i] = (text, old[i][1] if text == old[i][0] else len(text))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lined.collect()} == want

    single = stages["ngram_jaccard"](spark, lined, tables).cache()
    least = -(1 << 63)
    groups = linked_components([(least if i is None else i, t, None) for i, (t, _) in want.items()])
    stay = {None if i == least else i for i, (_, root) in groups.items() if i == root}
    assert {r["doc_id"] for r in single.collect()} == stay

    clean = stages["decontamination"](spark, single, tables).cache()
    assert {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()} == {20}
    assert tuple(clean.columns) == P.COLUMNS

    mixed = stages["mixing"](spark, clean, tables)
    sizes = {r["doc_id"]: len(r["text"].split()) for r in clean.collect()}
    got = mixed.collect()
    assert {r["doc_id"]: r["size"] for r in got} == sizes and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert rows_of(P.run(spark, tables)) == rows_of(mixed)


def test_empty_documents(spark, tables, tmp_path):
    sf = str(tmp_path)
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").limit(0).write.parquet(f"{sf}/benchmark.parquet")
    assert P.run(spark, sf).count() == 0
