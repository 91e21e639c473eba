"""Alignment of two tokenizers against whole-text encoding and a plain two-pointer walk."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heatgrid.llm import alignment
from heatgrid.llm.shared import kept

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts():
    rng = random.Random(4)
    words = ["the", "committee", "überraschung", "naïve", "1,234.5", "x", "don't", "日本語", "🙂🙂", "<|endoftext|>", "</s>", "a\tb", "\n\n", "  ",
             "é", "\x00", " ", "ZZZZ", "antidisestablishmentarianism", "foo_bar()", "...", "​", "\r\n"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out += [out[0], out[1], "", None, " ", "   ", "trailing ", "two trailing  ", "\n", "has ▁ in it", "a" * 5000, "word " * 30_000, " lead", "end  "]
    return out


def plain(rows):
    """The contract by whole-text encoding and a walk over both lists of byte ranges."""
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    place = alignment.byte_of()
    seen, docs = [], Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [bytes(place[c] for c in a.id_to_token(x)) for x in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ib for p in [b.id_to_piece(x)]]
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            seen.append((i, 0, 0, 0, [], ""))
            continue

        def ranges(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        ra, rb = ranges(ba), ranges(bb)
        both = sorted({y for _, y in ra} & {y for _, y in rb})
        x = y = 0
        groups, links = [], []
        for end in both:
            x0, y0 = x, y
            while x < len(ra) and ra[x][1] <= end:
                x += 1
            while y < len(rb) and rb[y][1] <= end:
                y += 1
            groups.append(",".join(map(str, ia[x0:x])) + "|" + ",".join(map(str, ib[y0:y])))
            links += [(ia[p], ib[q]) for p in range(x0, x) for q in range(y0, y) if ra[p][0] < rb[q][1] and rb[q][0] < ra[p][1]]
        docs.update(set(links))
        seen.append((i, len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    return sorted((i, na, nb, g, len(m), sum(docs[k] == best[k[0]] for k in m), sum(docs[k] for k in m), s) for i, na, nb, g, m, s in seen)


@pytest.mark.parametrize("limit", [alignment.MAX_PAIRS, 0])
def test_against_a_plain_walk(spark, limit, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 3000)  # in this process only: workers keep theirs
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    found = kept(alignment.alignments(docs)).df
    got = alignment.with_counts(found, limit).collect()
    mine = sorted((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                   hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert mine == plain(rows)


def test_portions_of_a_long_text(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 50)
    pair = alignment.tokenizers_of(A, B)
    for t in texts():
        if t and len(t) < 20_000:
            pieces = alignment.pieces_of(t)
            one, many = alignment.aligned(pair, [pieces])[0], alignment.whole(pair, pieces)
            assert (one is None) == (many is None)
            assert one is None or (one[:4] == many[:4] and (one[4] == many[4]).all())


def test_diagonal_on_random_ends():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 80)
        a = sorted(rng.sample(range(1, n), rng.randrange(n))) + [n]
        b = sorted(set(rng.sample(a, rng.randrange(len(a) + 1))) | {x for x in range(1, n) if rng.random() < 0.2} | {n})
        runs, groups, links = alignment.diagonal(a, b)
        all_links = links + [(i + k, j + k) for i, j, m in runs for k in range(m)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b))
                if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])]
        assert sorted(all_links) == want
        assert sum(m for *_, m in runs) + len(groups) == len(set(a) & set(b))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.with_counts(kept(alignment.alignments(docs)).df).collect() == []
