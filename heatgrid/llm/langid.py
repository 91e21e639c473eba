"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's words (runs of letters, lower-cased) give the word and its n-grams of UTF-8 bytes between marks;
each is hashed to a bucket. The text's vector is the average of its buckets' embeddings, a linear
softmax gives the classes. Since everything before the softmax is linear, a fitted model is one table
of class scores per bucket, at most BUCKETS x classes numbers, whatever the corpus.

Fitting uses at most `MAX_ROWS` labelled rows, those with the smallest hash of the id, whole texts. The
executors turn each text into its bucket counts, so no text and at most MAX_ROWS x BUCKETS counts
reach the driver. One part of these rows is held back from training: on it a temperature is fitted
that makes the softmax honest, and the rejection threshold is set so that at most `MAY_REJECT` of the
rows predicted rightly would be rejected.

Defined cases: null text, or text without a letter, gets `und`, score 0 and is rejected; with no
labelled row every text gets `und`; with one language every text with letters gets it; extra columns
are kept, columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.arrays import BASE, LOWERED, batch_bytes, mix, spans, texts_of, word_names

BUCKETS = 4096
SHIFT = np.uint64(64 - 12)
SIZES = (2, 3, 4)
SLICE_BYTES = 1 << 20
DIM = 16
MAX_ROWS = 3000
EPOCHS = 15
RATE = 2.0
MAY_REJECT = 0.002
UNKNOWN = "und"
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Subwords:
    """The distinct words of a slice of texts and the buckets of their subwords.

    words: per text, `of[at[i]:at[i + 1]]` are places of its words among the distinct ones;
    (word, bucket): one entry for each subword of each distinct word.
    """

    def __init__(self, column: pa.Array) -> None:
        data, offsets = batch_bytes(column)
        after = np.empty(len(data), bool)
        after[:1] = False
        after[1:] = data[:-1] == 0xC3
        capital = after & (data >= 0x80) & (data <= 0x9E)  # accented Latin capitals
        data = np.where(capital, data + np.uint8(0x20), data)
        starts, ends, self.at = spans(data, offsets, IS_LETTER)
        names = word_names(data, starts, ends, lower=True)
        distinct, first, self.of = np.unique(names, return_index=True, return_inverse=True)
        self.count = len(distinct)
        a, size = starts[first], ends[first] - starts[first]
        begin = np.cumsum(size + 2) - (size + 2)
        owner = np.repeat(np.arange(self.count), size + 2)
        flat = np.full(len(owner), ord("<"), np.uint8)
        flat[begin + size + 1] = ord(">")
        inner = np.arange(int(size.sum())) + np.repeat(begin + 1 - (np.cumsum(size) - size), size)
        flat[inner] = data[np.arange(len(inner)) + np.repeat(a - (np.cumsum(size) - size), size)]
        values = LOWERED[flat]
        word, bucket = [np.arange(self.count)], [mix(distinct) >> SHIFT]
        for n in SIZES:
            m = len(values) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h *= BASE
                h += values[j:j + m]
            whole = owner[:m] == owner[n - 1:]
            word.append(owner[:m][whole])
            bucket.append(mix(h[whole] + np.uint64(n)) >> SHIFT)
        self.word, self.bucket = np.concatenate(word), np.concatenate(bucket).astype(np.int64)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # bucket x class: embedding times softmax weights, divided by the temperature
    bias: np.ndarray
    threshold: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, weights, bias) by mini-batch gradient descent; rows of x are bucket shares that sum to one."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    x = x * np.float32(np.sqrt(x.shape[1]) / 4)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            i = order[at:at + 32]
            hidden = x[i] @ emb
            p = softmax(hidden @ out + bias)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            back = p @ out.T
            out -= rate * (hidden.T @ p)
            bias -= rate * p.sum(0)
            emb -= rate * (x[i].T @ back)
    return emb * np.float32(np.sqrt(x.shape[1]) / 4), out, bias


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss."""
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = MAX_ROWS) -> list:
    """(lang, buckets, counts) of at most max_rows labelled rows, those of the smallest id hashes."""
    place = F.xxhash64(F.lit("langid"), F.col(f"`{id_col}`"))
    usable = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    edge = usable.select(place.alias("p")).orderBy("p").limit(max_rows).agg(F.max("p").alias("p")).first()["p"]
    if edge is None:
        return []
    chosen = usable.where(place <= edge).select(
        place.alias("p"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, ns = [], []
            for i in range(batch.num_rows):
                subs = Subwords(batch.column(2).slice(i, 1))
                times = np.bincount(subs.of, minlength=subs.count)
                total = np.bincount(subs.bucket, times[subs.word], minlength=BUCKETS)
                hit = np.flatnonzero(total)
                ks.append(hit.astype(np.int16).tobytes())
                ns.append(total[hit].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ks, pa.binary()), pa.array(ns, pa.binary())], ["p", "lang", "k", "n"])

    rows = chosen.mapInArrow(counts, "p long, lang string, k binary, n binary")
    return rows.orderBy("p", "lang", "k", "n").limit(max_rows).collect()


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_rows: int = MAX_ROWS, may_reject: float = MAY_REJECT,
) -> Model:
    """Fit on labelled rows of `docs` (the caller leaves out what must be held out)."""
    rows = [r for r in sample(docs, id_col, text_col, lang_col, max_rows) if len(r["k"])]
    langs = sorted({r["lang"] for r in rows})
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS, max(1, len(langs))), np.float32), np.zeros(max(1, len(langs)), np.float32), 0.0)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        n = np.frombuffer(r["n"], np.float32)
        x[i, np.frombuffer(r["k"], np.int16)] = n / n.sum()
    y = np.array([langs.index(r["lang"]) for r in rows])
    held = np.arange(len(rows)) % 5 == 0
    if held.sum() < 20:
        held[:] = False
    emb, out, bias = train(x[~held], y[~held], len(langs))
    scores, threshold = emb @ out, 0.0
    if held.any():
        logits = x[held] @ scores + bias
        t = temperature(logits, y[held])
        scores, bias = scores / t, bias / t
        p = softmax(logits / t)
        right = p.argmax(1) == y[held]
        if right.any():
            threshold = float(min(0.5, np.quantile(p.max(1)[right], may_reject)))
    return Model(langs, scores.astype(np.float32), bias.astype(np.float32), threshold)


def class_scores(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities per class, number of words) of each text."""
    subs = Subwords(column)
    table = np.empty((subs.count, len(model.bias) + 1))
    for c in range(len(model.bias)):
        table[:, c] = np.bincount(subs.word, model.scores[:, c][subs.bucket], minlength=subs.count)
    table[:, -1] = np.bincount(subs.word, minlength=subs.count)
    words = np.diff(subs.at)
    total = np.zeros((len(column), table.shape[1]))
    some = np.flatnonzero(words)
    if len(some):
        total[some] = np.add.reduceat(table[subs.of], subs.at[:-1][some], axis=0)
    return softmax(total[:, :-1] / np.maximum(total[:, -1:], 1) + model.bias), words


def judgements(column: pa.Array, model: Model) -> pa.StructArray:
    """lang_pred, score and rejected of each text, by slices of SLICE_BYTES: what a slice needs is some 35 times its text."""
    column = pc.fill_null(column, b"")
    langs, scores, rejected = [], [], []
    for a, b in texts_of(column, SLICE_BYTES):
        part = column.slice(a, b - a)
        p, words = class_scores(part, model)
        best, top = p.argmax(1), p.max(1)
        for i in range(b - a):
            known = bool(model.langs) and words[i] > 0 and has_letter(part[i].as_py())
            langs.append(model.langs[best[i]] if known else UNKNOWN)
            scores.append(float(top[i]) if known else 0.0)
            rejected.append(not known or bool(top[i] < model.threshold))
    return pa.StructArray.from_arrays(
        [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
        ["lang_pred", "score", "rejected"])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, lang_pred, score (calibrated probability) and rejected."""

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def judge(column: pa.Array) -> pa.Array:
        return judgements(column, model)

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    judged = docs.select(*keep, judge(F.col(f"`{text_col}`").cast("binary")).alias("__r"))
    return judged.select(*keep, "__r.lang_pred", "__r.score", "__r.rejected")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
