"""Alignment of two tokenizers over the same bytes, with how often each pair of ids meets in the corpus.

Texts are cut before a blank that follows a character which is no white space; neither vocabulary has a
token over such a place (checked when a piece model is loaded), so the tokens of the pieces are the tokens
of the text. A task encodes and aligns equal pieces once: the pieces it has not met yet make one text.

Alignment is diagonal run skipping over the two arrays of token ends of that text. At the current shift between both
indices, exponential probing compares ever longer slices and jumps the stretch in which tokens end
together one by one; the first difference is an irregular group, settled locally by stepping whichever
side ends first until both end together, which also gives the overlapping pairs; the shift follows from
where that group ends.

Counts: a task returns the pairs of each document, distinct, with their multiplicity, as sorted packed
integers; they are stored. Documents per pair are summed in tasks, then by Spark. The table of pairs is
read back by every task while it has at most `max_pairs` rows (counted first); beyond that the documents'
pairs are joined with it by key, and no table is broadcast.

Defined cases: null or empty text, and texts whose tokens do not give back their bytes (U+2581 in the
text, for one), have no tokens: zeros and empty groups; ids may be null or repeat, every row is a document
of its own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.llm.shared import kept

CUT = re.compile(r"(?<=\S)(?= )")
CHUNK = 1 << 19
MEMO_PIECES = 150_000
MEMO_CHARS = 1 << 22
SHIFT = 24
MAX_PAIRS = 1 << 22
FLUSH = 1 << 21


# --- the two tokenizers -------------------------------------------------------------------------

def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this maps it back."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A `.json` byte-level vocabulary; special strings inside a text are plain text."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.model = Tokenizer.from_file(public_tokenizers.path(name))
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        place = byte_of()
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(place[c] for c in piece) if all(c in place for c in piece) else piece.encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceModel:
    """A sentencepiece `.model`; it puts a blank before what it encodes, so texts go in without theirs."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{name}: a piece holds a blank after another character, texts cannot be cut at blanks")
        self.blank = [self.model.piece_to_id("▁")]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        """`text` begins with the blank that the model adds itself."""
        return self.model.encode(text[1:], num_threads=1) if text != " " else self.blank


# --- diagonal run skipping ----------------------------------------------------------------------

def diagonal(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Align two rising lists of ends whose last ends are equal.

    Returns runs (i, j, n): tokens i.. and j.. end together one by one n times; irregular groups
    (i, i_end, j, j_end), ends exclusive; and the overlapping pairs (i, j) inside irregular groups.
    """
    runs, groups, links = [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        i0, j0 = i, j
        if a[i] == b[j]:
            i += 1
            j += 1
            k = 2
            while i < n and a[i:i + k] == b[j:j + k]:
                got = min(k, n - i)
                i += got
                j += got
                k *= 2
            while k > 1 and i < n:
                k >>= 1
                if i + k <= n and a[i:i + k] == b[j:j + k]:
                    i += k
                    j += k
            runs.append((i0, j0, i - i0))
            if i >= n:
                break
            i0, j0 = i, j
        links.append((i, j))
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            links.append((i, j))
        i += 1
        j += 1
        groups.append((i0, i, j0, j))
    return runs, groups, links


class Pieces:
    """The pieces a task has met, with their alignment. A cache: emptied when large, before a batch.

    New pieces are put together to one text, which is encoded by both tokenizers and aligned as a whole.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteLevel(a), PieceModel(b)
        self.len_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # piece -> number; -1 if its bytes are lost
        self.texts: list[str] = []
        self.chars = 0
        self.sizes: list[np.ndarray] = []  # rows of (tokens of A, tokens of B, groups, links)
        self.keys: list[np.ndarray] = []

    def learn(self, cut: list[list[str]]) -> None:
        if len(self.place) > MEMO_PIECES or self.chars > MEMO_CHARS:
            self.clear()
        new = list(dict.fromkeys([p for pieces in cut for p in pieces if p not in self.place]))
        self.chars += sum(map(len, new))
        # a piece that ends with white space would not end where the next begins
        inner = [p for p in new if not p[-1].isspace()]
        ends = [p for p in new if p[-1].isspace()]
        for some in ([inner] if inner else []) + [[p] for p in ends]:
            if not self.add(some):
                for p in some:  # one of them loses bytes
                    if len(some) == 1 or not self.add([p]):
                        self.place[p] = -1

    def add(self, pieces: list[str]) -> bool:
        """Encode and align pieces whose texts can stand one after the other; False if bytes are lost."""
        text = "".join(pieces)
        raw = text.encode()
        ia, ib = self.a.encode(text), self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, ib)) != raw or b"".join(map(self.a.bytes.__getitem__, ia)) != raw:
            return False
        fa, fb = np.array(ia, np.int64), np.array(ib, np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[fa]), np.cumsum(self.len_b[fb])
        to = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        to_a, to_b = np.searchsorted(ends_a, to), np.searchsorted(ends_b, to)
        if (ends_a[to_a] != to).any() or (ends_b[to_b] != to).any():
            raise ValueError("a token reaches over a blank")
        runs, groups, links = diagonal(ends_a.tolist(), ends_b.tolist())
        r = np.array(runs, np.int64).reshape(-1, 3)
        g = np.array(groups, np.int64).reshape(-1, 4)
        m = np.array(links, np.int64).reshape(-1, 2)
        ri, rj = stretched(r[:, 0], r[:, 2]), stretched(r[:, 1], r[:, 2])
        keys = np.concatenate([fa[ri] << SHIFT | fb[rj], fa[m[:, 0]] << SHIFT | fb[m[:, 1]]])
        at = np.concatenate([ri, m[:, 0]])
        order = np.argsort(at, kind="stable")
        at, keys = at[order], keys[order]
        text_of, first = [], []  # of every group, in order: runs and irregular groups take turns
        odd = iter(groups)
        after = next(odd, None)
        for i, j, n in runs:
            while after is not None and after[0] < i:
                text_of.append(",".join(map(str, ia[after[0]:after[1]])) + "|" + ",".join(map(str, ib[after[2]:after[3]])))
                after = next(odd, None)
            text_of += [f"{x}|{y}" for x, y in zip(ia[i:i + n], ib[j:j + n])]
        while after is not None:
            text_of.append(",".join(map(str, ia[after[0]:after[1]])) + "|" + ",".join(map(str, ib[after[2]:after[3]])))
            after = next(odd, None)
        first = np.sort(np.concatenate([ri, g[:, 0]]))  # first token of A of every group
        group_to, link_to = np.searchsorted(first, to_a + 1).tolist(), np.searchsorted(at, to_a + 1)
        start = len(self.texts)
        g0 = 0
        for g1 in group_to:
            self.texts.append(";".join(text_of[g0:g1]))
            g0 = g1
        self.sizes.append(np.stack([np.diff(to_a, prepend=-1), np.diff(to_b, prepend=-1), np.diff(group_to, prepend=0), np.diff(link_to, prepend=0)], 1))
        self.keys.append(keys)
        self.place.update(zip(pieces, range(start, start + len(pieces))))
        return True

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, where each piece's keys begin, keys)."""
        if len(self.sizes) > 1:
            self.sizes, self.keys = [np.concatenate(self.sizes)], [np.concatenate(self.keys)]
        sizes = self.sizes[0] if self.sizes else np.zeros((0, 4), np.int64)
        return sizes, np.cumsum(sizes[:, 3]) - sizes[:, 3], self.keys[0] if self.keys else np.zeros(0, np.int64)


PIECES: dict[tuple[str, str], Pieces] = {}


def tokenizers_of(a: str, b: str) -> Pieces:
    """Once per Python worker."""
    if (a, b) not in PIECES:
        PIECES[a, b] = Pieces(a, b)
    return PIECES[a, b]


def stretched(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (n[0] of them), start[1], .."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def aligned(known: Pieces, parts: list[list[str]]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
    """(tokens of A, tokens of B, groups, groups as text, keys of all links) of each list of pieces; None if bytes are lost."""
    known.learn(parts)
    sizes, begin, keys = known.tables()
    place, texts = known.place, known.texts
    out: list = [None] * len(parts)
    for k, pieces in enumerate(parts):
        where = [place[p] for p in pieces]
        if not where or min(where) < 0:
            continue
        at = np.array(where)
        mine = sizes[at]
        a, b, g, _ = mine.sum(0).tolist()
        out[k] = (a, b, g, ";".join([texts[i] for i in where]), keys[stretched(begin[at], mine[:, 3])])
    return out


# --- the operator -------------------------------------------------------------------------------

def pack(keys: np.ndarray) -> tuple[bytes, int]:
    """The distinct keys and their multiplicities, as differences, compressed; and the bytes before that."""
    u, n = np.unique(keys, return_counts=True)
    raw = np.concatenate([np.diff(u, prepend=0), n]).astype("<i8").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpack(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), "<i8") if size else np.zeros(0, np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def pieces_of(text: str) -> list[str]:
    """A blank and the text, cut at safe places."""
    return CUT.split(" " + text) if text else []


def portions(pieces: list[str]) -> Iterator[list[str]]:
    """Runs of pieces of about CHUNK characters: all groups end at their borders."""
    part, size = [], 0
    for p in pieces:
        part.append(p)
        size += len(p)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def whole(pair: Pieces, pieces: list[str]) -> tuple[int, int, int, str, np.ndarray] | None:
    """A long text, portion by portion."""
    got = []
    for part in portions(pieces):
        x = aligned(pair, [part])[0]
        if x is None:
            return None
        got.append(x)
    a, b, g, texts, keys = zip(*got)
    return sum(a), sum(b), sum(g), ";".join(texts), np.concatenate(keys)


def alignments(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, pairs_size) of every row of `docs`.

    groups is `a1,a2|b1;a3|b2,b3`; pairs holds the distinct linked id pairs and their multiplicities.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pairs_size"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers_of(a, b)
        nothing = (0, 0, 0, "", np.zeros(0, np.int64))

        def result(ids: pa.Array, found: list) -> pa.RecordBatch:
            found = [x or nothing for x in found]
            packed = [pack(x[4]) for x in found]
            longs = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1, 2)]
            return pa.RecordBatch.from_arrays(
                [ids, *longs, pa.array([len(x[4]) for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string()),
                 pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.int64())], names)

        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            at, todo, size = 0, [], 0
            for k in range(len(column)):
                text = column[k].as_py()
                if len(text) > CHUNK:
                    if todo:
                        yield result(ids.slice(at, k - at), aligned(pair, todo))
                    yield result(ids.slice(k, 1), [whole(pair, pieces_of(text))])
                    at, todo, size = k + 1, [], 0
                    continue
                todo.append(pieces_of(text))
                size += len(text)
                if size >= CHUNK:
                    yield result(ids.slice(at, k + 1 - at), aligned(pair, todo))
                    at, todo, size = k + 1, [], 0
            if todo:
                yield result(ids.slice(at), aligned(pair, todo))

    return texts.mapInArrow(rows, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, pairs_size long")


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, docs): how many documents hold each pair; summed in tasks before rows move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in waiting]), len(keys)).astype(np.int64)

        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "docs"])

        for batch in batches:
            for packed, n in zip(batch.column(0), batch.column(1)):
                keys, _ = unpack(packed.as_py(), n.as_py())
                waiting.append((keys, np.ones(len(keys), np.int64)))
                size += len(keys)
                if size > FLUSH:
                    waiting = [merged()]
                    size = len(waiting[0][0])
                    if size > FLUSH // 2:  # too many different ones to hold
                        yield batch_of(*waiting[0])
                        waiting, size = [], 0
        if waiting:
            yield batch_of(*merged())

    parts = found.select("pairs", "pairs_size").where("pairs_size > 0").mapInArrow(count, "key long, docs long")
    return parts.groupBy("key").agg(F.sum("docs").alias("docs"))


def with_counts(found: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """`found` (a stored result of `alignments`) with n_best and count_sum in place of its packed pairs."""
    counts = kept(pair_counts(found)).df
    a = F.shiftright("key", SHIFT)
    keep = [c for c in found.columns if c not in ("pairs", "pairs_size")]
    if counts.count() <= max_pairs:
        table = counts.select("key", "docs").toArrow()  # at most max_pairs rows of 16 bytes
        keys, docs = table.column("key").to_numpy(), table.column("docs").to_numpy()
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        start = np.flatnonzero(np.diff(keys >> SHIFT, prepend=-1))
        best = docs == np.repeat(np.maximum.reduceat(docs, start), np.diff(start, append=len(keys))) if len(keys) else np.zeros(0, bool)
        shared = found.sparkSession.sparkContext.broadcast((keys, docs, best))

        @F.arrow_udf("struct<n_best: bigint, count_sum: bigint>")
        def looked_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            keys, docs, best = shared.value
            for packed, sizes in batches:
                n_best, total = [], []
                for p, n in zip(packed, sizes):
                    mine, times = unpack(p.as_py(), n.as_py())
                    where = np.searchsorted(keys, mine)
                    n_best.append(int(times[best[where]].sum()))
                    total.append(int((times * docs[where]).sum()))
                yield pa.StructArray.from_arrays([pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], ["n_best", "count_sum"])

        return found.withColumn("got", looked_up("pairs", "pairs_size")).select(*keep, "got.n_best", "got.count_sum")

    # each row gets a number, stored, to bring its pairs together again
    numbered = kept(found.withColumn("no", F.monotonically_increasing_id())).df
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    judged = kept(counts.withColumn("a", a).join(top, "a").select("key", "docs", (F.col("docs") == F.col("most")).alias("best"))).df

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, packed, n in zip(batch.column(0), batch.column(1), batch.column(2)):
                keys, times = unpack(packed.as_py(), n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), no.as_py(), np.int64)), pa.array(keys), pa.array(times)], ["no", "key", "times"])

    each = kept(numbered.select("no", "pairs", "pairs_size").where("pairs_size > 0").mapInArrow(pairs, "no long, key long, times long")).df
    sums = each.join(judged, "key").groupBy("no").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return numbered.join(sums, "no", "left").select(*keep, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
