"""Lines that stand in many documents, by two Bloom filters and an exact count of what they suspect.

1. Every task marks the keys of its documents' lines in two filters, of keys seen once and of keys seen
   twice; a tree of sums makes one filter of the keys that at least two documents have.
2. Only lines whose key that filter suspects leave their task, as a 128-bit digest of the key.  They are
   counted exactly; a digest also knows the first document and line that has it.
3. Documents drop the lines whose key is in enough of them.

The filter has a fixed size.  When a corpus fills it, more lines are suspected and travel, as digests; the
result stays the same.

A row is a document: rows with one id count one each.  Null and empty texts are one empty line.  Equal rows
(id and text) drop the same lines.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusgauge.functions.joins import spread_join
from corpusgauge.functions.text import settled
from corpusgauge.llm.bpe import cut_batches
from corpusgauge.llm.common import table
from corpusgauge.llm.sketches import SLICES, SeenTwice, has, twice_seen
from corpusgauge.session import written_once

GAPS = " \t\n\x0b\x0c\r"
#: Text handled at a time in a task.
BATCH_BYTES = 4_000_000
#: Size of each filter; 16 MB of the second one go to every executor.
BITS = 2**27


def line_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and key number of every line that has a key, and the keys' digests (two 64-bit numbers each)."""
    lines = pc.split_pattern(texts, "\n")
    ends = lines.offsets.to_numpy()
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(ends[:-1] - ends[0], counts)
    coded = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=GAPS)).dictionary_encode()
    codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.cast(pa.binary()).to_pylist())
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)[codes]
    return owner[long], place[long], codes[long], np.frombuffer(digests, "<u8").reshape(-1, 2)


def pairs_of(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts a document's lines of one key side by side, and where each such pair begins in it."""
    pair = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(pair, kind="stable")
    return order, np.flatnonzero(np.diff(pair[order], prepend=-1))


def suspected(docs: DataFrame, min_chars: int = 1, bits: int = BITS) -> DataFrame:
    """(doc_id, text_hash, high, low, lines): lines of every document by key, for keys that two documents may have.

    One row per document and key, its line numbers from 0 in order.  The rows are written before the filter goes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def mark(batches):
        from pyspark import TaskContext

        seen = SeenTwice(bits)
        for _, texts in cut_batches(batches, BATCH_BYTES):
            owner, _, codes, digests = line_keys(texts, min_chars)
            order, begins = pairs_of(owner, codes)
            once_each = digests[codes[order[begins]]]
            seen.add((once_each % np.uint64(bits)).ravel())
        yield from seen.slices(TaskContext.get().partitionId())

    tasks = rows.rdd.getNumPartitions()
    filled = spark.sparkContext.broadcast(twice_seen(rows.mapInArrow(mark, SLICES), tasks, bits).tobytes())
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def pick(batches):
        twice = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            at = 0
            for ids, texts in cut_batches([batch], BATCH_BYTES):
                hashes, at = batch.column(2).to_numpy()[at : at + len(texts)], at + len(texts)
                owner, place, codes, digests = line_keys(texts, min_chars)
                keep = has(twice, digests % np.uint64(bits)).all(axis=1)[codes]
                owner, place, codes = owner[keep], place[keep], codes[keep]
                order, begins = pairs_of(owner, codes)
                first = order[begins]
                found = digests[codes[first]].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                columns = [ids.take(pa.array(owner[first])).cast(kind), pa.array(hashes[owner[first]]), pa.array(found[:, 0]), pa.array(found[:, 1]), lists]
                yield pa.record_batch(columns, names=["doc_id", "text_hash", "high", "low", "lines"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = written_once(rows.mapInArrow(pick, f"doc_id {id_type}, text_hash long, high long, low long, lines array<int>"))
    filled.destroy()
    return found


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, text_hash, dropped): numbers of the lines whose key is in at least ``min_docs`` documents.

    With ``keep_first`` the first line of such a key stays, in the document of the least id (nulls last, then by
    hash of the text).  A key of very many documents is counted in parts, and its rows are spread when it is joined back.
    """
    found = suspected(docs, min_chars, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    often = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"), first).where(F.col("docs") >= min_docs)
    rows = spread_join(found, often.drop("docs"), ["high", "low"], "inner", spread_by=["doc_id", "text_hash"])
    if keep_first:
        own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
        rows = rows.withColumn("lines", F.when(own, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")))
    return rows.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("lines")).alias("dropped"))


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): documents without the lines that many have."""
    gone = dropped_lines(docs, min_docs, min_chars, keep_first, bits)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    joined = rows.join(gone, same, "left")
    none = F.array().cast("array<int>")
    cut = settled(joined, ["doc_id"], lines=F.split("text", "\n", -1), dropped=F.coalesce(F.array_distinct("dropped"), none))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    chosen = settled(cut, ["doc_id", "lines", F.size("dropped").cast("long").alias("n_dropped")], stays=stays)
    return chosen.select(
        "doc_id", F.array_join(F.transform("stays", lambda i: F.get("lines", i)), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"), "n_dropped",
    )


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least ten have."""
    return kept_lines(table(spark, sf_dir, "documents"))


def kept_lines(docs: DataFrame) -> DataFrame:
    return without_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def line_dedup_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB text of :func:`kept_lines`."""
    gaps = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (SELECT r, i, line, translate(trim(line, {gaps}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
often AS (SELECT k FROM keyed WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT r) >= {min_docs}),
marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often USING (k)),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (r)
"""
