"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes.

Files hold ``doc_id, n_tokens, ids`` in ascending order of id, nulls first, one range of ids per file.  Ids are
dictionary-encoded (the dictionary is no longer than the vocabulary) or delta-encoded; small pages with
column and offset indexes let a reader take the ids of a few documents, or the lengths of all, without
the rest.  The place of a document in the whole row of ids follows from the lengths alone.
"""

from __future__ import annotations

import functools
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.functions.joins import broadcast_if_small
from corpusgauge.llm.bpe import cut_batches, default_vocabulary, encode_words, split_words, spread, tokenizer, word_bytes, words_from
from corpusgauge.llm.common import gives_back, table
from corpusgauge.session import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 64 * 2**20
PAGE_BYTES = 64 * 2**10
PAGE_ROWS = 1_000
#: Memory for each of two generations of encoded words that a Python worker keeps, what a word takes beside its letters and ids,
#: and the longest word kept.
KNOWN_BYTES, ENTRY_BYTES, LONGEST_KNOWN = 48 * 2**20, 170, 100
#: Text encoded at a time: arrays of places and ids are several times as large.
BATCH_BYTES = 4_000_000


class Known:
    """Words that this worker has encoded lately, with their ids.

    Two generations: a word is looked up in the newer one, then in the older, and encoded if neither has it; when the newer has
    ``KNOWN_BYTES`` it becomes the older.  So a batch costs what its own words cost, however many are known.
    """

    def __init__(self, path: str):
        self.path, self.new, self.old, self.size = path, {}, {}, 0

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has, as :func:`encode_words` gives them.

        Words that differ in their closing marks alone are one word here, and the marks another.
        """
        stems, marks = (x.dictionary_encode() for x in without_marks(words, closing_marks(self.path)))
        spelt = pc.not_equal(marks.dictionary, "")
        ids, counts = self.found(pa.concat_arrays([stems.dictionary, marks.dictionary.filter(spelt)]))
        of_marks = np.zeros(len(spelt), np.int64)
        some = spelt.to_numpy(zero_copy_only=False)
        of_marks[some], of_marks[~some] = np.arange(len(stems.dictionary), len(counts)), len(counts)
        counts = np.append(counts, 0)  # no marks, no ids
        both = np.stack((stems.indices.to_numpy().astype(np.int64), of_marks[marks.indices.to_numpy()]), 1)
        starts, sizes = np.cumsum(counts) - counts, counts[both]
        return ids[spread(starts[both.ravel()], sizes.ravel())], sizes.sum(1)

    def found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        spelt = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.new.get, spelt))
        fresh = [i for i, ids in enumerate(found) if ids is None]  # a word that the newer generation has costs no more than this
        for i in fresh:
            found[i] = self.old.get(spelt[i])
        missing = [i for i in fresh if found[i] is None]
        ids, counts = encode_words(words.take(pa.array(missing, pa.int64())), self.path)
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        for i, start, end in zip(missing, (ends - 4 * counts).tolist(), ends.tolist(), strict=True):
            found[i] = flat[start:end]
        kept = {spelt[i]: found[i] for i in fresh if len(spelt[i]) <= LONGEST_KNOWN}
        self.new.update(kept)
        self.size += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        if self.size > KNOWN_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


@functools.lru_cache(maxsize=1)
def closing_marks(path: str) -> str:
    """ASCII marks before which this tokenizer always cuts a word that ends in a letter or digit.

    An apostrophe may begin a word's ending, and marks of added tokens may belong to one.
    """
    cut, normalizer = tokenizer(path).pre_tokenizer, tokenizer(path).normalizer
    if cut is None or normalizer is not None:
        return ""
    held = {"'", *(c for token in tokenizer(path).get_added_tokens_decoder().values() for c in token.content)}
    alone = {m for m in string.punctuation if all(len(cut.pre_tokenize_str(f" {c}{m}{m}")) == 2 for c in ("a", "1", "\u00e9", "\u4e2d"))}
    return "".join(sorted(alone - held))


def without_marks(words: pa.Array, marks: str) -> tuple[pa.Array, pa.Array]:
    """``words`` without the closing ``marks`` behind a letter or digit, and these marks; most words have none."""
    cut = pc.ascii_rtrim(words, marks) if marks else words
    whole = pc.or_(pc.match_substring_regex(words, r"<\|"), pc.invert(pc.match_substring_regex(cut, r"[\p{L}\p{N}]$")))
    stems = pc.if_else(whole, words, cut)
    lengths, data = word_bytes(words)
    beyond = lengths - pc.binary_length(stems).to_numpy(zero_copy_only=False)
    letters = np.frombuffer(data, np.uint8)
    return stems, words_from(beyond, letters[spread(np.cumsum(lengths) - beyond, beyond)].tobytes())


@functools.lru_cache(maxsize=1)
def known(path: str) -> Known:
    return Known(path)


def file_options(encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES) -> dict[str, str]:
    """Writer options: format version 2, encoding of the ids, sizes of row groups and pages."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": str(2**20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) with the partitions of ``docs``; a word that the worker has met lately is not encoded again."""

    def encode(batches):
        for doc_ids, texts in cut_batches(batches, BATCH_BYTES):
            distinct, places, ends = split_words(texts)
            ids, counts = known(path).encode(distinct)
            starts, first, at = np.cumsum(counts) - counts, np.append(0, ends), 0
            while at < len(texts):  # index arrays are several times the ids, so a few documents at a time
                to = max(at + 1, int(np.searchsorted(ends, first[at] + 500_000, "right")))
                some = places[first[at] : ends[to - 1]]
                flat = ids[spread(starts[some], counts[some])].astype(np.int32)
                upto = np.append(0, np.cumsum(counts[some]))
                sizes = np.diff(upto[np.append(first[at], ends[at:to]) - first[at]])
                if end_id is not None:
                    flat, sizes = np.insert(flat, np.cumsum(sizes), end_id), sizes + 1
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.record_batch(
                    [doc_ids[at:to], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))],
                    names=["doc_id", "n_tokens", "ids"],
                )
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(gives_back(encode), f"doc_id {kind}, n_tokens long, ids array<int>")


def write_token_files(docs: DataFrame, out: str, path: str | None = None, **options) -> str:
    """Documents (doc_id, text) as token files, one exchange of the texts into ranges of ids.

    Ranges have no fixed number, so adaptive execution sizes them by bytes.  Null texts have the end
    id alone; rows with equal ids keep the order of their texts; other columns are not read.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tokenized(ordered, path or default_vocabulary()).write.options(**file_options(**options)).parquet(out)
    return out


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, doc_id, n_tokens), without reading any ids."""
    return spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens"
    )


def file_starts(lengths: DataFrame) -> DataFrame:
    """(file, base): ids in the files before; one row per file meets in one window."""
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lengths.groupBy("file").agg(F.sum("n_tokens").alias("n"), first)
        .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )


def with_starts(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``rows`` (file, row, n_tokens, ...) with ``start``: the number of ids of all documents before."""
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return (
        inside.join(broadcast_if_small(file_starts(lengths)), "file")
        .withColumn("start", F.col("base") + F.col("_inside")).drop("base", "_inside")
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, doc_id, n_tokens, ids_crc32): crc32 of the ids as little-endian 32-bit numbers.

    A list that has not the length stored beside it raises an error.
    """

    def check(batches):
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy().astype(np.int64)
            sizes, stored = np.diff(ends), batch.column(3).to_numpy()
            if (sizes != stored).any():
                raise ValueError(f"{batch.column(0)[0]}: ids and n_tokens disagree")
            data = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64())], names=names)

    names = ["file", "row", "doc_id", "n_tokens", "ids_crc32"]
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens", "ids"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(gives_back(check), f"file string, row long, doc_id {kind}, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; the filter reaches row groups and pages by their indexes."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files, and what these hold."""
    out = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return with_starts(read_checksums(spark, out), read_lengths(spark, out)).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )
