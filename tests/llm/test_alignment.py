"""Alignment of two tokenizers against plain loops over their tokens' byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, empty, rows
from hypothesis import given as given_texts
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgauge.llm import alignment, bpe

A, B = bpe.default_vocabulary(), alignment.default_pieces()


def ranges(ids, spelt):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spelt[i]), i))
        at += len(spelt[i])
    return out


def by_loop(given):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of (doc_id, text) rows."""
    a_bytes, b_bytes, model = bpe.pieces(A), alignment.piece_bytes(B), alignment.piece_tokenizer(B)
    found, counts = [], Counter()
    for d, t in given:
        a = alignment.byte_tokenizer(A).encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        if not t or any(b"".join(x[i] for i in ids) != (" " + t).encode() for x, ids in ((a_bytes, a), (b_bytes, b))):
            found.append((d, [], [], [], ""))
            continue
        ra, rb = ranges(a, a_bytes), ranges(b, b_bytes)
        links, j = [], 0
        for s, e, i in ra:
            while rb[j][1] <= s:
                j += 1
            k = j
            while k < len(rb) and rb[k][0] < e:
                links.append((i, rb[k][2]))
                k += 1
        cuts = {e for _, e, _ in ra} & {e for _, e, _ in rb}
        groups, own = [], [[], []]
        for e, side, i in sorted([(e, 0, i) for _, e, i in ra] + [(e, 1, i) for _, e, i in rb], key=lambda x: x[:2]):
            own[side].append(str(i))
            if side and e in cuts:
                groups.append("|".join(map(",".join, own)))
                own = [[], []]
        counts.update(links)
        found.append((d, a, b, links, ";".join(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted(
        [(d, len(a), len(b), groups.count("|"), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), groups) for d, a, b, x, groups in found],
        key=repr,
    )


def given():
    odd = [
        (500, "<|endoftext|> <s></s> <unk> <0x41>"), (501, " leading"), (502, "two  blanks  "), (503, "▁ marks ▁"), (504, "\x00\x01"),
        (505, " nbsp　wide"), (506, "🙂🙃 emoji 👩‍👩‍👧"), (507, "ﬁ ligature é"), (508, "\r\nline\r\n"), (509, " "), (510, "日本語のテキスト"),
    ]
    return [*[(i, t) for i, t, _ in rows()], *odd]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@settings(max_examples=150, deadline=None)
@given_texts(st.lists(st.lists(st.sampled_from([*"ab '\n\t\r\u00a0\u3000\u00e91.!<|>▁\x00", "<|endoftext|>", "  ", "<s>", "\n\n", "\u0301"]), max_size=25).map("".join), max_size=5))
def test_tokens_of_words_are_those_of_texts(texts):
    (ids_a, sizes_a), (ids_b, sizes_b) = alignment.tokens_of(pa.array(texts, pa.string()), A, B)
    ends_a, ends_b = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b))
    for i, t in enumerate(texts):
        a, b = alignment.byte_tokenizer(A).encode(" " + t, add_special_tokens=False).ids, alignment.piece_tokenizer(B).encode(t)
        same = t and all(b"".join(x[j] for j in ids) == (" " + t).encode() for x, ids in ((bpe.pieces(A), a), (alignment.piece_bytes(B), b)))
        assert ids_a[ends_a[i] : ends_a[i + 1]].tolist() == (a if same else [])
        assert ids_b[ends_b[i] : ends_b[i + 1]].tolist() == (b if same else [])


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize(("batch", "block"), [(1_000, 3_000), (4_000_000, 16_000_000)])
def test_aligned_like_the_loop(spark, batch, block, whole, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    if whole:
        monkeypatch.setattr(alignment, "ALIGNED", 2_000)
    docs = documents(spark, [(i, t, "s") for i, t in given()])
    got = sorted((tuple(r) for r in alignment.aligned(docs, texts_too=True).select(COLUMNS).collect()), key=repr)
    want = by_loop(given())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 50 and any(r[1] == 0 and r[0] is not None and r[0] > 499 for r in got)
    digests = {r["doc_id"]: r["groups"] for r in alignment.aligned(docs.where("doc_id >= 7")).collect()}
    texts = {r[0]: r[7] for r in want if r[0] is not None and r[0] >= 7}
    assert digests == {d: hashlib.sha256(g.encode()).hexdigest() if g else "" for d, g in texts.items()}


def test_counts_are_those_of_the_corpus(spark):
    docs = documents(spark, [(i, t, "s") for i, t in given()])
    blocks = alignment.alignment_blocks(docs, A, B)
    total = alignment.corpus_pairs(alignment.pair_counts(blocks)).agg(F.sum("links")).first()[0]
    assert total == sum(r[4] for r in by_loop(given()))


def test_aligned_of_no_rows_and_no_tokens(spark):
    assert alignment.aligned(empty(spark)).collect() == []
    got = alignment.aligned(documents(spark, [(1, None, "a"), (None, "", "a")])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
