"""Distinct-word BPE and token files against the tokenizer on whole texts."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import bpe, token_files
from corpusgauge.session import scratch_path

PATH = bpe.default_vocabulary()


def ids_of(text):
    return bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def expected():
    out = []
    for i, text, _ in rows():
        ids = ids_of(text)
        back = bpe.tokenizer(PATH).decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [2_000, 32_000_000])
def test_encoded_and_decoded_like_the_library(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(bpe.cut_batches, "__defaults__", (block_bytes,))
    got = sorted((tuple(r) for r in bpe.encoded_and_decoded(documents(spark)).collect()), key=repr)
    assert got == expected()


def test_ids_of_any_kind_decode_like_the_library(spark):
    lists = [(1, [50256, 0, 255, 128, 200, 13]), (2, []), (3, None), (4, [220, 220, 447, 222])]
    df = spark.createDataFrame(lists, "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", bpe.decoded(df.ids).alias("t")).collect()}
    want = {i: None if x is None else bpe.tokenizer(PATH).decode(x, skip_special_tokens=False) for i, x in lists}
    assert got == want


def test_other_blocks_on_a_second_reading_are_an_error(spark):
    docs = documents(spark)
    words = bpe.blocks_of(docs, 8, words=True).groupBy("shard").applyInArrow(bpe.encode_shard(PATH), bpe.PARTS)
    other = bpe.blocks_of(docs.where("doc_id > 3"), 8, words=False)
    fill = bpe.fill_block(pa.int64(), PATH, False)
    with pytest.raises(Exception, match="another order"):
        other.unionByName(words).groupBy("block").applyInArrow(fill, "doc_id long, ids array<int>").collect()


def test_no_rows(spark):
    assert bpe.encode(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab '\n\t\r\u00a0\u3000\u00e91.!<|>", "<|endoftext|>", "  ", "'s"]), max_size=25).map("".join), max_size=5))
def test_words_put_together_are_the_text_and_encode_alike(texts):
    distinct, places, ends = bpe.split_words(pa.array(texts, pa.string()))
    words = distinct.to_pylist()
    assert len(set(words)) == len(words)
    start = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        own = [words[p] for p in places[start:end]]
        assert "".join(own) == text
        assert [i for w in own for i in ids_of(w)] == ids_of(text)
        start = end
    ids, counts = bpe.encode_words(distinct, PATH)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [ids_of(w) for w in words]


def test_packing_is_exact():
    a, b = np.array([0, 1, 255, 256, 2**32 - 1]), np.zeros(0, np.int64)
    assert [x.tolist() for x in bpe.unpack(bpe.pack(a, b))] == [a.tolist(), []]


def test_pieces_are_the_bytes_of_ids():
    table = bpe.pieces(PATH)
    assert table[50256] == b"<|endoftext|>" and len(table) == 50257
    assert b"".join(table[i] for i in ids_of("naïve 中 \x00")) == "naïve 中 \x00".encode()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, encoding):
    out = token_files.write_token_files(documents(spark), scratch_path(spark, "tokens"), encoding=encoding)
    got = token_files.with_starts(token_files.read_checksums(spark, out), token_files.read_lengths(spark, out))
    start, want = 0, []
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for i, text, _ in order:
        ids = [*ids_of(text), token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want
    files = [f for f in spark.read.parquet(out).inputFiles()]
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata
    column = next(meta.row_group(0).column(j) for j in range(meta.num_columns) if "ids" in meta.row_group(0).column(j).path_in_schema)
    assert any(("DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY") in e for e in column.encodings)
    assert column.has_offset_index and column.has_column_index and column.compression == "ZSTD"
    few = {r["doc_id"]: r["ids"] for r in token_files.read_ids(spark, out, [1, 215]).collect()}
    texts = {i: t for i, t, _ in rows()}
    assert few == {i: [*ids_of(texts[i]), token_files.END_ID] for i in (1, 215)}
    plan = token_files.read_ids(spark, out, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in plan
    lengths = token_files.read_lengths(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in lengths.split("ReadSchema")[1]


def test_known_words_are_not_encoded_again(monkeypatch):
    calls = []
    monkeypatch.setattr(token_files, "encode_words", lambda w, p: calls.extend(w.to_pylist()) or bpe.encode_words(w, p))
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 3 * token_files.ENTRY_BYTES)
    known = token_files.Known(PATH)
    batches = [["a", " b"], [" b", "a", " é"], [" c", " b"], [" d", " b", " c"], list("ghijklmn"), ["x" * 200, ""], ["x" * 200, "g"], []]
    fresh = [["a", " b"], [" é"], [" c"], [" d"], list("ghijklmn"), ["x" * 200, ""], ["x" * 200], []]
    for words, want in zip(batches, fresh, strict=True):
        calls.clear()
        ids, counts = known.encode(pa.array(words, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [ids_of(w) for w in words]
        assert calls == want
        assert len(known.new) + len(known.old) <= 16


def test_words_with_other_closing_marks_are_one_word(monkeypatch):
    calls = []
    monkeypatch.setattr(token_files, "encode_words", lambda w, p: calls.extend(w.to_pylist()) or bpe.encode_words(w, p))
    known = token_files.Known(PATH)
    words = [" word", " word.", " word,", "\nword...", " word?!", " don't.", " they're;", " a's", " é,", " 1.5.", " ...", ".", " x<|", " x<|endoftext|>.", " x'.", " 中文。.", " \u0301.", " a\u0301,", " ²!", ""]
    for _ in range(2):
        ids, counts = known.encode(pa.array(words, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [ids_of(w) for w in words]
    assert calls.count(" word") == 1 and not {" word.", " word,", " word?!", " é,"} & set(calls)
    assert not set("'<|>") & set(token_files.closing_marks(PATH))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé1²中\u0301'sst.,;!*<|_-", max_size=12), min_size=1, max_size=8))
def test_marks_apart_give_the_ids_of_the_whole_word(words):
    words = list(dict.fromkeys(" " + w for w in words))
    ids, counts = token_files.Known(PATH).encode(pa.array(words, pa.string()))
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [ids_of(w) for w in words]


def test_a_known_word_is_looked_up_once():
    class Counting(dict):
        looks = 0

        def get(self, key, default=None):
            Counting.looks += 1
            return super().get(key, default)

        def __contains__(self, key):
            Counting.looks += 1
            return super().__contains__(key)

    known = token_files.Known(PATH)
    known.new, known.old = Counting(), Counting()
    words = pa.array([" a", " b", " é", ""])
    first = [x.tolist() for x in known.encode(words)]
    Counting.looks = 0
    assert [x.tolist() for x in known.encode(words)] == first
    assert Counting.looks == len(words)


def test_token_files_without_rows(spark):
    out = token_files.write_token_files(empty(spark), scratch_path(spark, "tokens"))
    assert token_files.with_starts(token_files.read_checksums(spark, out), token_files.read_lengths(spark, out)).collect() == []
    with pytest.raises(ValueError, match="encoding"):
        token_files.file_options("plain")
