"""Byte-pair encoding by a table of distinct words, and decoding by a table of pieces.

Texts are cut at blanks and line ends into words, each with the blank or line end before it.
A byte-level tokenizer never merges across such a cut as long as no white space stands on its other
sides, so words can be encoded alone; words at other cuts (double blanks, blanks at line ends)
stay together as one.  The steps:

1. blocks of documents are split; a block is written as its documents' word numbers (most frequent
   word 0), and its distinct words in shards by hash;
2. per shard, the distinct words of all blocks are encoded, each once, and every block gets the
   ids of its words back;
3. per block, word numbers are replaced by ids in place.

What is exchanged is each block's distinct words, their ids and its compressed word numbers, never texts.
No word is in more than one shard and a block has bounded size, so no task grows with a
frequent word.  Texts are split once for the words and once for the numbers, as writing both down took
more disk than splitting takes time.  Both see the same blocks, also when a lost task runs again, as long as the
documents come from a table; a seal over a block's words raises an error should they ever differ.

The vocabulary file is a parameter; it is read on every executor.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusgauge.llm.common import gives_back, table

#: Text in one block; a longer document is a block by itself.
BLOCK_BYTES = 6_000_000
LEAST_SHARDS = 8
#: Words given to the tokenizer in one string.
TOGETHER = 200
#: Input partitions for each shard beyond the least.
PARTITIONS_PER_SHARD = 4
#: White space of any kind, as Unicode has it.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SEPARATORS = ("", " ", "\n")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=2)
def piece_sizes(path: str) -> np.ndarray:
    return np.array([len(p) for p in pieces(path)], np.int64)


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each has."""
    found = tokenizer(path)  # its added tokens match before any cut
    return encode_rows(words, lambda rows: [e.ids for e in found.encode_batch_fast(rows, add_special_tokens=False)], piece_sizes(path), r"<\|")


def encode_rows(words: pa.Array, call, sizes: np.ndarray, apart: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers for a ``call`` from strings to lists of ids, whose bytes are ``sizes`` long.

    Words between which a tokenizer cuts anyway are handed to it in rows of ``TOGETHER``; the bytes of
    the ids tell whose they are.  Words with ``apart`` go alone.
    """
    simple = pc.match_substring_regex(words, f"^[ \n][^{SPACE[1:-1]}]").to_numpy(zero_copy_only=False)
    simple &= pc.match_substring_regex(words, f"[^{SPACE[1:-1]}]$").to_numpy(zero_copy_only=False)
    simple &= ~pc.match_substring_regex(words, apart).to_numpy(zero_copy_only=False)
    order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
    many = int(simple.sum())
    ordered = words.take(pa.array(order))
    texts = ordered[:many].to_pylist()
    rows = ["".join(texts[i : i + TOGETHER]) for i in range(0, many, TOGETHER)]
    parts = [np.array(ids, np.uint32) for i in range(0, len(rows), 256) for ids in call(rows[i : i + 256])]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    ends = np.cumsum(pc.binary_length(ordered[:many]).to_numpy(zero_copy_only=False))
    upto = np.searchsorted(np.cumsum(sizes[flat]), ends, "left") + 1 if many else ends
    singles = call(ordered[many:].to_pylist())
    counts = np.concatenate((np.diff(upto, prepend=0), np.array([len(x) for x in singles], np.int64)))
    flat = np.concatenate((flat, np.array([i for x in singles for i in x], np.uint32)))
    starts, back = np.cumsum(counts) - counts, np.argsort(order)
    return flat[spread(starts[back], counts[back])], counts[back]


def cut_batches(batches, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) arrays of up to ``most`` bytes of text; null texts are empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.column(0)[start:end], texts[start:end]
            start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at each place, and the number of places up to each document's end."""
    lines = pc.split_pattern(texts, "\n")
    words = pc.split_pattern(lines.flatten(), " ")
    line_starts = words.offsets.to_numpy()
    doc_starts = line_starts[lines.offsets.to_numpy()]
    coded = words.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    n = len(codes)
    before = np.ones(n, np.int64)
    before[line_starts[:-1]] = 2
    before[doc_starts[:-1]] = 0
    open_start = pc.match_substring_regex(known, f"^$|^{SPACE}").to_numpy(zero_copy_only=False)
    open_end = pc.match_substring_regex(known, f"^$|{SPACE}$").to_numpy(zero_copy_only=False)
    joined = np.zeros(n, bool)
    joined[1:] = open_end[codes[:-1]] | open_start[codes[1:]]
    joined[doc_starts[:-1]] = False
    starts = np.flatnonzero(~joined)
    keys = codes[starts] * np.int64(3) + before[starts]
    lengths = np.diff(np.append(starts, n))
    together: dict[str, int] = {}
    for i in np.flatnonzero(lengths > 1).tolist():
        places = range(starts[i], starts[i] + lengths[i])
        whole = "".join(SEPARATORS[before[p]] + known[codes[p]].as_py() for p in places)
        keys[i] = 3 * len(known) + together.setdefault(whole, len(together))
    used = np.zeros(3 * len(known) + len(together), bool)
    used[keys] = True
    number = np.cumsum(used) - 1
    simple = np.flatnonzero(used[: 3 * len(known)])
    gaps = pa.array(SEPARATORS).take(pa.array(simple % 3))
    alone = pc.binary_join_element_wise(gaps, known.take(pa.array(simple // 3)), "")
    coded = pa.concat_arrays([alone, pa.array(list(together), pa.string())]).dictionary_encode()  # a blank at a start may be in both
    places = coded.indices.to_numpy(zero_copy_only=False)[number[keys]].astype(np.int64)
    return coded.dictionary, places, np.cumsum(~joined)[doc_starts[1:] - 1] if n else np.zeros(0, np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of the runs that begin at ``starts`` and have ``counts`` members."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


# packing for the exchange


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of their weight, compressed."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        parts += [len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        found.append(np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64))
        at += 8 + 4 * n
    return found


def word_bytes(words: pa.Array) -> tuple[np.ndarray, bytes]:
    words = pa.concat_arrays([words])  # offsets from 0
    ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    return np.diff(ends), words.buffers()[2].to_pybytes()[: ends[-1]] if len(words) and words.buffers()[2] else b""


def words_from(lengths: np.ndarray, data: bytes) -> pa.Array:
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data))


def shard_of(words: pa.Array, shards: int) -> np.ndarray:
    """Shard of each word, by a hash of its bytes that is the same everywhere."""
    return np.fromiter((zlib.crc32(w.as_buffer()) % shards for w in words.cast(pa.binary())), np.int64, len(words))


PARTS = "block string, shard int, seal long, numbers binary, bytes binary, doc_ids binary"
_PARTS = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("seal", pa.int64()), ("numbers", pa.binary()), ("bytes", pa.binary()), ("doc_ids", pa.binary())])


def blocks_of(docs: DataFrame, shards: int, words: bool) -> DataFrame:
    """Step 1: per block its words, a row for each shard, or a row (shard -1) with its word numbers."""

    def numbers(places, ends, n, ids):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as out:
            out.write_batch(pa.record_batch([ids], names=["doc_id"]))
        return {"shard": -1, "numbers": pack(places, np.diff(ends, prepend=0), np.array([n])), "doc_ids": sink.getvalue().to_pybytes()}

    def by_shard(distinct):
        shard = shard_of(distinct, shards)
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            lengths, data = word_bytes(distinct.take(pa.array(mine)))
            yield {"shard": s, "numbers": pack(np.diff(mine, prepend=0), lengths), "bytes": zstandard.ZstdCompressor(level=1).compress(data)}

    def split(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for no, (ids, texts) in enumerate(cut_batches(batches)):
            distinct, places, ends = split_words(texts)
            by_count = np.argsort(-np.bincount(places, minlength=len(distinct)), kind="stable")
            rank = np.empty(len(distinct), np.int64)
            rank[by_count] = np.arange(len(distinct))
            distinct = distinct.take(pa.array(by_count))
            seal = zlib.crc32(word_bytes(distinct)[1], len(distinct))
            for row in by_shard(distinct) if words else [numbers(rank[places], ends, len(distinct), ids)]:
                yield pa.RecordBatch.from_pylist([{"block": f"{task}-{no}", "seal": seal} | row], _PARTS)

    return docs.select("doc_id", "text").mapInArrow(gives_back(split), PARTS)


def encode_shard(path: str):
    """Step 2: encodes the distinct words of a shard and hands the ids back block by block."""

    def encode(part: pa.Table) -> pa.Table:
        unpacked = [unpack(x) for x in part["numbers"].to_pylist()]
        opener = zstandard.ZstdDecompressor()
        lists = [words_from(n[1], opener.decompress(b)) for n, b in zip(unpacked, part["bytes"].to_pylist(), strict=True)]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids, counts = encode_words(coded.dictionary, path)
        starts = np.cumsum(counts) - counts
        codes, at, rows = coded.indices.to_numpy(zero_copy_only=False), 0, []
        for block, seal, (gaps, _) in zip(part["block"].to_pylist(), part["seal"].to_pylist(), unpacked, strict=True):
            mine = codes[at : at + len(gaps)]
            at += len(gaps)
            rows.append({"block": block, "seal": seal, "shard": part["shard"][0].as_py(), "numbers": pack(gaps, counts[mine], ids[spread(starts[mine], counts[mine])]), "bytes": None, "doc_ids": None})
        return pa.Table.from_pylist(rows, _PARTS)

    return gives_back(encode)


def spelt(ids: np.ndarray, sizes: np.ndarray, path: str) -> list[str]:
    """Texts of lists of ids in a row, each id joined to its piece; bytes that are not UTF-8 are replaced."""
    table, lengths = pieces(path), piece_sizes(path)
    letters = np.frombuffer(b"".join(table), np.uint8)
    starts, out, at = np.cumsum(lengths) - lengths, [], 0
    for n in sizes.tolist():
        mine = ids[at : at + n]
        at += n
        out.append(letters[spread(starts[mine], lengths[mine])].tobytes().decode("utf-8", "replace"))
    return out


def fill_block(doc_id: pa.DataType, path: str, texts: bool):
    """Step 3: word numbers of a block replaced by ids, and these by the text that they decode to."""

    def fill(part: pa.Table) -> pa.Table:
        rows = {r["shard"]: r for r in part.to_pylist()}
        if len({r["seal"] for r in rows.values()}) > 1 or -1 not in rows:
            raise ValueError("documents came in another order on a second reading: write them to a table first")
        own = rows.pop(-1)
        places, per_doc, (n,) = unpack(own["numbers"])
        parts = [unpack(r["numbers"]) for r in rows.values()]
        counts = np.zeros(n, np.int64)
        for gaps, c, _ in parts:
            counts[np.cumsum(gaps)] = c
        starts = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), np.int32)
        for gaps, c, i in parts:
            ids[spread(starts[np.cumsum(gaps)], c)] = i
        doc_ids = pa.ipc.open_stream(own["doc_ids"]).read_all()["doc_id"].combine_chunks()
        ends, lists = np.append(0, np.cumsum(per_doc)), []
        sizes = np.add.reduceat(np.append(counts[places], 0), ends[:-1]) * (per_doc > 0) if len(per_doc) else per_doc
        for i in range(0, len(places), 1_000_000):  # the index arrays are large, so a piece at a time
            some = places[i : i + 1_000_000]
            lists.append(ids[spread(starts[some], counts[some])])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        out = {"doc_id": doc_ids.cast(doc_id), "ids": pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))}
        return pa.table(out | {"decoded": pa.array(spelt(flat, sizes, path), pa.string())} if texts else out)

    return gives_back(fill)


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """(doc_id, ids) of every document; null and empty texts have no ids, repeated rows each theirs.

    With ``decode`` also ``decoded``, the text of the ids, made in the task that has them.
    """
    path = path or default_vocabulary()
    shards = max(LEAST_SHARDS, docs.rdd.getNumPartitions() // PARTITIONS_PER_SHARD)
    kind = docs.schema["doc_id"].dataType
    words = blocks_of(docs, shards, words=True).groupBy("shard").applyInArrow(encode_shard(path), PARTS)
    out = f"doc_id {kind.simpleString()}, ids array<int>" + ", decoded string" * decode
    return (
        blocks_of(docs, shards, words=False).unionByName(words).groupBy("block")
        .applyInArrow(fill_block(to_arrow_type(kind), path, decode), out)
    )


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Bytes of each id: byte-level tokens are spelt in one letter per byte, added tokens as they are."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    found = tokenizer(path)
    added = found.get_added_tokens_decoder()
    table = [b""] * (max(found.get_vocab().values()) + 1)
    for token, i in found.get_vocab().items():
        spelt = i not in added and all(c in byte_of for c in token)
        table[i] = bytes(byte_of[c] for c in token) if spelt else token.encode()
    return table


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids: each id joined to its piece, the bytes read as UTF-8.

    The table of pieces is as long as the vocabulary, whatever the corpus.  Bytes that are not
    UTF-8 become replacement characters; null ids give a null text.
    """
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def join(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else spelt(np.asarray(x, np.int64), np.array([len(x)]), path)[0])

    return join(ids)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(numbers, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
