"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries: before a blank or line feed that follows a character which is no
white space. The byte-level pre-tokenizer never lets a token reach over such a place, and the added
special token holds no white space, so the counts of the pieces add up to the count of the text.
Long texts become many small pieces, equal pieces of a task are encoded once, and what is left to
encode goes to the library in batches balanced by bytes, not by rows. Only lengths come back.

The tokenizer file is a parameter; every Python worker loads it once.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are
handled as the library does by default; extra columns are kept, columns named like the results are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 18
MEMO_PIECES = 500_000
MEMO_CHARS = 40
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
def tokenizer(name: str):
    """The library's batch encoder of a public vocabulary file, as a function to lists of lengths."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def byte_batches(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about `limit` bytes; a longer piece is a batch of its own."""
    batch, size = [], 0
    for p in pieces:
        n = len(p) if p.isascii() else 3 * len(p)
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(p)
        size += n
    if batch:
        yield batch


class PieceCounts(dict):
    """piece -> number of tokens, for the pieces of the texts seen by this task. A cache: emptied when large."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def lengths(self, texts: list[str], safe: re.Pattern | None) -> list[int]:
        if safe is None:
            return [n for batch in byte_batches(texts) for n in self.encode(batch)]
        cut = [safe.split(t) for t in texts]
        new = list({p for pieces in cut for p in pieces} - self.keys())
        if len(self) + len(new) > MEMO_PIECES:
            self.clear()
            new = list({p for pieces in cut for p in pieces})
        for batch in byte_batches(new):
            self.update(zip(batch, self.encode(batch)))
        out = [sum(map(self.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self[p]
        return out


COUNTS: dict[str, PieceCounts] = {}


def piece_counts(name: str) -> PieceCounts:
    """One tokenizer and one cache per Python worker."""
    if name not in COUNTS:
        COUNTS[name] = PieceCounts(tokenizer(name))
    return COUNTS[name]


def count_tokens(
    docs: DataFrame, text_col: str = "text", name: str = "byte_bpe_50k.json", limit: int = 512,
) -> DataFrame:
    """All columns of `docs`, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    safe = SAFE if name == "byte_bpe_50k.json" else None

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = piece_counts(name)
        for column in batches:
            out: list[int] = []
            chunk, size = [], 0
            for text in column:
                t = text.as_py()
                chunk.append(t)
                size += len(t)
                if size >= 4 * BATCH_BYTES:
                    out += counts.lengths(chunk, safe)
                    chunk, size = [], 0
            out += counts.lengths(chunk, safe)
            yield pa.array(out, pa.int64())

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return docs.select(
        *keep, F.octet_length(text).cast("long").alias("n_bytes"), lengths(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
