"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Per batch of documents, ``pandas.merge_asof`` keyed by document finds for each token start the token of
the other side that covers it; both directions together are all overlaps.  Places where tokens of both
sides end cut the tokens into groups.  A block of documents keeps the distinct pairs of ids that it links; only these, not links,
are exchanged to be counted over the corpus, and each block gets the counts of its own pairs back.

Both tokenizers cut at blanks and line ends between words, so a batch's distinct words are encoded once.  Both vocabulary files are
parameters, read on every executor.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusgauge.llm.bpe import cut_batches, default_vocabulary, encode_rows, pieces, split_words, spread, word_bytes
from corpusgauge.llm.common import table
from corpusgauge.session import written_once

#: Text whose words are encoded together, tokens aligned at a time, and text whose pairs are kept as one block.
BATCH_BYTES = 4_000_000
ALIGNED = 400_000
BLOCK_BYTES = 16_000_000


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """The byte-level tokenizer, special tokens in texts being ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=2)
def piece_tokenizer(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each id of the second tokenizer: its mark of a blank is one, byte pieces are their byte."""
    model = piece_tokenizer(path)
    return [
        bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


class Spelling:
    """Strings of ids in one buffer."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.letters[spread(self.starts[ids], self.sizes[ids])]


@functools.lru_cache(maxsize=4)
def spelling(kind: str, path: str) -> Spelling:
    return Spelling(pieces(path) if kind == "a" else piece_bytes(path))


@functools.lru_cache(maxsize=1)
def decimals(n: int) -> Spelling:
    """Each number with room for a separator after it."""
    return Spelling([b"%d," % i for i in range(n)])


@functools.lru_cache(maxsize=2)
def cuts_words(path: str) -> bool:
    """Whether the second tokenizer changes no text and has no piece across the cuts between words."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    rules = spec.normalizer_spec
    plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
    return plain and not any(re.search("[^▁]▁|\n", p.piece) for p in spec.pieces)


def encoded(words: pa.Array, a_path: str, b_path: str):
    """(ids, counts) of both sides for words that begin with a blank or line end."""

    def a_ids(rows):
        return [e.ids for e in byte_tokenizer(a_path).encode_batch_fast(rows, add_special_tokens=False)]

    def b_ids(rows):
        # the blank that the tokenizer puts before a text is the row's own, or goes again before a line end
        lists = piece_tokenizer(b_path).encode([r[1:] if r[0] == " " else r for r in rows], num_threads=1)
        return [x if r[0] == " " else x[1:] for r, x in zip(rows, lists, strict=True)]

    a = encode_rows(words, a_ids, spelling("a", a_path).sizes, r"\x00")
    b = encode_rows(words, b_ids, spelling("b", b_path).sizes, "[▁\x00]") if cuts_words(b_path) else singly(words, b_ids)
    return a, b


def singly(words: pa.Array, call):
    lists = call(words.to_pylist())
    counts = np.array([len(x) for x in lists], np.int64)
    return np.array([i for x in lists for i in x], np.uint32), counts


def spelt_alike(words: pa.Array, ids: np.ndarray, counts: np.ndarray, spelt: Spelling) -> np.ndarray:
    """Whether the bytes of each word's ids are those of the word."""
    sizes, data = word_bytes(words)
    first = np.cumsum(counts) - counts
    upto = np.append(0, np.cumsum(spelt.sizes[ids]))
    good = upto[first + counts] - upto[first] == sizes
    own = np.flatnonzero(good)
    found = spelt.of(ids[spread(first[own], counts[own])])
    given = np.frombuffer(data, np.uint8)[spread((np.cumsum(sizes) - sizes)[own], sizes[own])]
    other = np.searchsorted(np.cumsum(sizes[own]), np.flatnonzero(found != given), "right")
    good[own[other]] = False
    return good


def tokens_of(texts: pa.Array, a_path: str, b_path: str):
    """(ids, sizes) of both sides; texts that do not come back from both as a blank and themselves have no tokens."""
    spaced = pc.binary_join_element_wise("", texts, " ")
    if cuts_words(b_path):
        words, places, ends = split_words(spaced)
    else:
        words, places, ends = spaced, np.arange(len(texts)), np.arange(1, len(texts) + 1)
    sides = encoded(words, a_path, b_path)
    alike = np.logical_and(*[spelt_alike(words, ids, counts, spelling(*kind)) for (ids, counts), kind in zip(sides, (("a", a_path), ("b", b_path)), strict=True)])
    per_doc = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(texts)), per_doc)
    keep = (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0) & (np.bincount(doc[~alike[places]], minlength=len(texts)) == 0)
    places, doc = places[keep[doc]], doc[keep[doc]]
    out = []
    for ids, counts in sides:
        first = np.cumsum(counts) - counts
        sizes = np.bincount(doc, counts[places], len(texts)).astype(np.int64)
        out.append((ids[spread(first[places], counts[places])].astype(np.int64), sizes))
    return out


def overlaps(ids_a, sizes_a, ids_b, sizes_b, a_path: str, b_path: str):
    """(document, id, id) of all overlapping tokens, in the order of their places, and group numbers of the tokens of either side."""
    frames, ends = [], []
    for ids, sizes, spelt in ((ids_a, sizes_a, spelling("a", a_path)), (ids_b, sizes_b, spelling("b", b_path))):
        end = np.cumsum(spelt.sizes[ids])
        ends.append(end)
        frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(sizes)), sizes), "start": end - spelt.sizes[ids], "id": ids}))
    a, b = frames
    covering = pd.merge_asof(a, b, on="start", by="doc", suffixes=("_a", "_b"))  # the token of b that covers each start of a
    covered = pd.merge_asof(b, a.assign(at=a["start"]), on="start", by="doc", suffixes=("_b", "_a"))
    covered = covered[covered["at"] < covered["start"]]  # equal starts have been found from the other side
    links = pd.concat([covering[["doc", "start", "id_a", "id_b"]], covered[["doc", "start", "id_a", "id_b"]]]).sort_values("start", kind="stable")
    cuts = np.intersect1d(*ends, assume_unique=True)  # documents with tokens have bytes, so ends differ between documents
    return links, np.searchsorted(cuts, ends[0]), np.searchsorted(cuts, ends[1])


def written_groups(ids_a, sizes_a, groups_a, ids_b, sizes_b, groups_b) -> tuple[list[bytes], np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of every document, and its number of groups."""
    doc = np.concatenate([np.repeat(np.arange(len(s)), s) for s in (sizes_a, sizes_b)])
    key = np.concatenate((2 * groups_a, 2 * groups_b + 1))
    order = np.argsort(key, kind="stable")
    ids, key, doc = np.concatenate((ids_a, ids_b))[order], key[order], doc[order]
    room = decimals(1 << max(int(ids.max(initial=0)).bit_length(), 16))
    letters, ends = room.of(ids), np.cumsum(room.sizes[ids])
    step = np.diff(key >> 1, append=-1) != 0
    side = np.diff(key, append=-1) != 0
    letters[ends - 1] = np.where(step, ord(";"), np.where(side, ord("|"), ord(",")))
    upto = np.append(0, ends)[np.append(0, np.cumsum(sizes_a + sizes_b))]
    n_groups = np.bincount(doc[step], minlength=len(sizes_a)) if len(doc) else np.zeros(len(sizes_a), np.int64)
    return [letters[s : max(e - 1, s)].tobytes() for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], n_groups


BLOCK_FIELDS = "block string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>, id_a array<int>, id_b array<int>, n array<long>"


def alignment_blocks(docs: DataFrame, a_path: str, b_path: str, texts_too: bool = False) -> DataFrame:
    """A row per document, its pairs by number in the block, and one row per block (``id_a`` not null) with the block's pairs.

    ``groups`` is the digest of a document's groups, or with ``texts_too`` the groups themselves.
    """
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    fields = pa.schema([
        ("doc_id", arrow), ("block", pa.string()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()),
        *[(n, pa.list_(pa.int32())) for n in ("pairs", "times", "id_a", "id_b")], ("n", pa.list_(pa.int64())),
    ])

    def some(doc_ids, texts):
        """The documents of a batch with their tokens, a few at a time."""
        (ids_a, sizes_a), (ids_b, sizes_b) = tokens_of(texts, a_path, b_path)
        ends_a, ends_b, at = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b)), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends_a, ends_a[at] + ALIGNED, "right")) - 1)
            yield one(doc_ids[at:to], ids_a[ends_a[at] : ends_a[to]], sizes_a[at:to], ids_b[ends_b[at] : ends_b[to]], sizes_b[at:to])
            at = to

    def one(doc_ids, ids_a, sizes_a, ids_b, sizes_b):
        """Columns of documents, and their pairs as (keys, times, pairs of each document)."""
        links, groups_a, groups_b = overlaps(ids_a, sizes_a, ids_b, sizes_b, a_path, b_path)
        spelt, n_groups = written_groups(ids_a, sizes_a, groups_a, ids_b, sizes_b, groups_b)
        doc = links["doc"].to_numpy()
        keys = links["id_a"].to_numpy(np.int64) << 32 | links["id_b"].to_numpy(np.int64)
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        begins = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(keys, prepend=-1) != 0))
        times = np.diff(np.append(begins, len(doc)))
        said = [g.decode() if texts_too else hashlib.sha256(g).hexdigest() if g else "" for g in spelt]
        n_links = np.bincount(doc, minlength=len(sizes_a))
        per_doc = np.bincount(doc[begins], minlength=len(sizes_a))
        return [doc_ids, sizes_a, sizes_b, n_groups, n_links, said], keys[begins], times, per_doc

    def block(name, done):
        keys, at = np.unique(np.concatenate([k for _, k, _, _ in done]), return_inverse=True)
        start = 0
        for (doc_ids, *numbers, said), k, times, per_doc in done:
            offsets = pa.array(np.append(0, np.cumsum(per_doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at[start : start + len(k)], times)]
            start += len(k)
            n = len(doc_ids)
            columns = [doc_ids.cast(arrow), pa.array([name] * n), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(said), *lists]
            yield pa.record_batch([*columns, *[pa.nulls(n, fields.field(i).type) for i in range(len(columns), len(fields))]], schema=fields)
        total = np.bincount(at, np.concatenate([t for _, _, t, _ in done]), len(keys)).astype(np.int64)
        own = {f.name: None for f in fields} | {"block": name, "id_a": (keys >> 32).tolist(), "id_b": (keys & 0xFFFFFFFF).tolist(), "n": total.tolist()}
        yield pa.RecordBatch.from_pylist([own], fields)

    def align(batches):
        from pyspark import TaskContext

        task, no, held, done = TaskContext.get().partitionId(), 0, 0, []
        for doc_ids, texts in cut_batches(batches, BATCH_BYTES):
            done += some(doc_ids, texts)
            held += pc.sum(pc.binary_length(texts)).as_py() or 0
            if held >= BLOCK_BYTES:
                yield from block(f"{task}-{no}", done)
                no, held, done = no + 1, 0, []
        if done:
            yield from block(f"{task}-{no}", done)

    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id {kind.simpleString()}, {BLOCK_FIELDS}")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, pair, id_a, id_b, n) of the blocks of :func:`alignment_blocks`."""
    found = blocks.where("id_a IS NOT NULL").select("block", F.posexplode(F.arrays_zip("id_a", "id_b", "n")).alias("pair", "p"))
    return found.select("block", "pair", "p.id_a", "p.id_b", "p.n")


def corpus_pairs(pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, links, best): links of each pair of ids in the corpus, and whether no other pair of its second id has more.

    A second id has at most as many rows as the first vocabulary has ids, whatever the corpus.
    """
    counts = pairs.groupBy("id_a", "id_b").agg(F.sum("n").alias("links"))
    most = counts.groupBy("id_b").agg(F.max("links").alias("most"))
    return counts.join(most, "id_b").select("id_a", "id_b", "links", (F.col("links") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, texts_too: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    Null and empty texts, and texts whose bytes a tokenizer does not give back, have zeros and empty groups.  Repeated
    rows are aligned and counted each; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    blocks = written_once(alignment_blocks(docs, a_path or default_vocabulary(), b_path or default_pieces(), texts_too))
    pairs = pair_counts(blocks)
    scored = pairs.join(corpus_pairs(pairs), ["id_a", "id_b"]).select(F.col("block").alias("of"), "pair", "links", "best")
    own = blocks.where("id_a IS NULL").drop("id_a", "id_b", "n")

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        order = np.argsort(right["pair"].to_numpy())
        links, best = right["links"].to_numpy()[order], right["best"].to_numpy()[order]
        lists = pa.concat_arrays(left["pairs"].chunks) if left["pairs"].num_chunks else pa.array([], pa.list_(pa.int32()))
        ends = lists.offsets.to_numpy().astype(np.int64)
        at = lists.values.to_numpy()[ends[0] : ends[-1]]
        times = left["times"].combine_chunks().flatten().to_numpy().astype(np.int64)

        def summed(x):
            upto = np.append(0, np.cumsum(x))
            return pa.array(np.diff(upto[ends - ends[0]]))

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        values = [left["doc_id"].cast(arrow), *[left[n] for n in names[1:5]], summed(times * best[at]), summed(times * links[at]), left["groups"]]
        return pa.table(values, names=names)

    out = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return own.groupBy("block").cogroup(scored.groupBy("of")).applyInArrow(fill, out)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents aligned, with the counts of the whole corpus."""
    return aligned(table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")
