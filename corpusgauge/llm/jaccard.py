"""N-gram Jaccard join with set relations: lists skipped in blocks, answers taken from similar sets.

A document is the set of its k-word shingles.  Sets with a Jaccard similarity of the threshold or
more are linked; the result is each document's component.  The join is exact:

* *Index.*  Tokens have one order, rare before frequent (by a fixed-size sketch of counts over all
  documents).  Linked sets share a token among the first ``n - ceil(t n) + 1`` of each, so only those are indexed, with
  their position and the size of their set.  Equal sets are one.
* *Skipping by position and size.*  Lists are cut into blocks of sizes; a block meets itself and
  the next only.  As the smaller of two, a set can only be found at its first positions, so entries
  further back are skipped as a block; a pair is taken up when sizes and positions still allow enough tokens
  in common.  Then the parities of token counts in classes, about as many as tokens, give a lower bound of the difference of two sets.
* *Answers from a similar set.*  Sets that agree with a set in three of six minimal hashes form its family.
  Within a family nothing is looked up in the index: a member is written as what it lacks of the pivot and what
  it has beyond it, and the overlap of two members follows from these short differences and
  the pivot's size.  Where the sizes of the differences alone decide, they are not compared; members
  already in one component are not compared either.  A family is dealt in chunks, and pairs of members never become rows.
* Pivots and sets without a family are looked up first.  What a pivot is linked with, its component has.  A list in which another
  component stands is then walked by families, and once for all tokens that the same families share: it gives pairs of families,
  not of their members.  Their pivots' difference is counted; sets whose own differences from their
  pivots leave room for a link meet as one family, and their pairs do not become rows either.
* Pairs that pass all bounds are verified on their whole sets, which are taken from the texts of just these documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.llm.bpe import cut_batches
from corpusgauge.llm.common import gives_back, table
from corpusgauge.llm.graph import components
from corpusgauge.llm.shingles import BATCH_BYTES, mixed, shingle_sets
from corpusgauge.llm.sketches import summed
from corpusgauge.session import in_small_batches, written_once

K, PERCENT = 3, 90
#: Counters of the frequency sketch (16 bits each), and slices in which tasks hand them on.
COUNTERS, SLICES = 2**22, 64
#: Bits of the filter of documents whose sets are needed; others that pass it cost time only.
FILTER_BITS = 2**24
#: Least classes of the parities; there are as many as half the tokens or more, a power of two.
PARITIES = 512
FAMILY_KEYS, FAMILY_VOTES = 6, 3
FAMILY_CHUNK = 2_000
KEY_SALTS = mixed(np.arange(1, FAMILY_KEYS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
INDEX_ENTRIES = 300_000


def set_id(s: np.ndarray) -> int:
    """A 64-bit identity of a set; the same for equal sets everywhere."""
    mix = mixed(np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int((mix[:1] * np.uint64(3) + mix[1:]).astype(np.int64)[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each class, 64 to a number."""
    width = max(PARITIES, 1 << (max(len(s) - 1, 1).bit_length() - 1))
    odd = np.bincount((s >> np.uint64(8) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_in(batches, k: int):
    """(doc_id, set) of each row, a few megabytes of text at a time."""
    for ids, texts in cut_batches(batches, BATCH_BYTES):
        yield from zip(ids, shingle_sets(texts, k), strict=True)


# first pass: sizes, identities, family keys, parities, and the sketch


def measured(docs: DataFrame, k: int) -> DataFrame:
    """Per document a short row (slice -1), per task and slice of the sketch its counts (``n`` is the task)."""
    kind = docs.schema["doc_id"].dataType
    arrow = {"slice": pa.int32(), "n": pa.int64(), "set_id": pa.int64(), "keys": pa.list_(pa.int64()), "parity": pa.list_(pa.int64()), "counts": pa.binary()}

    def measure(batches):
        from pyspark import TaskContext

        sketch, seen = np.zeros(COUNTERS, np.uint32), set()
        for ids, texts in cut_batches(batches, BATCH_BYTES):
            sets = shingle_sets(texts, k)
            rows, fresh = {name: [] for name in arrow}, []
            for s in sets:
                known = len(s) > 0
                own = set_id(s) if known else None
                rows["slice"].append(-1)
                rows["n"].append(len(s))
                rows["set_id"].append(own)
                rows["keys"].append([int(mixed(s ^ salt).min().astype(np.int64)) for salt in KEY_SALTS] if known else None)
                rows["parity"].append(parities(s) if known else None)
                rows["counts"].append(None)
                if known and own not in seen:
                    seen.add(own)
                    fresh.append(s)
            if fresh:
                np.add.at(sketch, (np.concatenate(fresh) & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            yield pa.record_batch([ids, *[pa.array(rows[n], t) for n, t in arrow.items()]], names=["doc_id", *arrow])
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(np.minimum(x, 2**16 - 1).astype("<u2").tobytes()) for x in np.split(sketch, SLICES)]
        ids = pa.nulls(SLICES, to_arrow_type(kind))
        task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64())
        empty = [pa.nulls(SLICES, t) for t in list(arrow.values())[2:-1]]
        yield pa.record_batch([ids, pa.array(range(SLICES), pa.int32()), task, *empty, pa.array(parts, pa.binary())], names=["doc_id", *arrow])

    return docs.select("doc_id", "text").mapInArrow(
        gives_back(measure),
        f"doc_id {kind.simpleString()}, slice int, n long, set_id long, keys array<long>, parity array<long>, counts binary",
    )


def frequency_classes(sketch: DataFrame, tokens: int, tasks: int) -> np.ndarray:
    """Class of each counter: 0 up to half above the mean, then one more with every doubling.

    ``sketch`` has (slice, part, data) of ``tasks`` tasks.  ``SLICES`` rows come to the driver, two bytes a counter,
    whatever the corpus.  Counters stop at 65,535, and any order of tokens gives the same links.
    """
    base = 1.5 * tokens / COUNTERS + 8

    def add(x, y):
        return np.minimum(x.view("<u2").astype(np.uint32) + y.view("<u2"), 2**16 - 1).astype("<u2").view(np.uint8)

    classes, step = np.zeros(COUNTERS, np.uint8), COUNTERS // SLICES
    for row in summed(sketch, tasks, add).select("slice", "data").collect():
        total = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["data"])), "<u2")
        found = np.where(total <= base, 0, 1 + np.floor(np.log2(np.maximum(total, 1) / base))).clip(0, 15)
        classes[row["slice"] * step : (row["slice"] + 1) * step] = found
    return classes


# second pass: the index


def least_shared(a, b, percent: int):
    """Tokens that two sets of these sizes need in common."""
    return -(-percent * (a + b) // (100 + percent))


def index_entries(docs: DataFrame, classes: np.ndarray, k: int, percent: int, buckets: int) -> DataFrame:
    """(token, set_id, n, p) of the lists in which two sets of fitting sizes meet.

    Tasks hand on their entries in buckets by token; a bucket drops tokens of a single set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def emit(held):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = (mixed(columns[0]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((columns[0], bucket))
        columns, bucket = [c[order] for c in columns], bucket[order]
        pack = zstandard.ZstdCompressor(level=1)
        for b, rows in zip(*group_runs(bucket), strict=True):
            data = [pack.compress(np.ascontiguousarray(c[rows]).tobytes()) for c in columns]
            yield pa.record_batch([pa.array([int(b)], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["bucket", "token", "set_id", "n", "p"])

    def entries(batches):
        table, seen, held, size = shared.value, set(), [], 0
        for _, s in sets_in(batches, k):
            if not len(s) or (own := set_id(s)) in seen:
                continue
            seen.add(own)
            n = len(s)
            first = n - -(-percent * n // 100) + 1
            ranked = s >> np.uint64(4) | table[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(60)
            tokens = np.sort(np.partition(ranked, first - 1)[:first])
            held.append((tokens, np.full(first, own, np.int64), np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
            size += first
            if size >= INDEX_ENTRIES:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    def lists(part: pa.Table) -> pa.Table:
        opener = zstandard.ZstdDecompressor()
        token, own, n, p = (
            np.concatenate([np.frombuffer(opener.decompress(x.as_py()), kind) for x in part[name]])
            for name, kind in (("token", np.uint64), ("set_id", np.int64), ("n", np.int32), ("p", np.int32))
        )
        order = np.lexsort((own, n, token))
        token, own, n, p = token[order], own[order], n[order], p[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1]) | (n[1:] != n[:-1])
        token, own, n, p = token[fresh], own[fresh], n[fresh], p[fresh]
        near = (token[1:] == token[:-1]) & (n[:-1].astype(np.int64) * 100 >= n[1:].astype(np.int64) * percent)
        some = np.zeros(len(token), bool)
        some[1:] |= near
        some[:-1] |= near
        return pa.table({"token": token[some].astype(np.int64), "set_id": own[some], "n": n[some], "p": p[some]})

    packed = docs.select("doc_id", "text").mapInArrow(gives_back(entries), "bucket int, token binary, set_id binary, n binary, p binary")
    found = written_once(packed.groupBy("bucket").applyInArrow(gives_back(lists), "token long, set_id long, n int, p int"))
    shared.destroy()
    return found


def group_runs(keys: np.ndarray) -> tuple[list, list[slice]]:
    """Values of a sorted array and where each stands."""
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(cuts[1:], len(keys))
    return keys[cuts].tolist(), [slice(a, b) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]


# families


def families(sets: DataFrame) -> DataFrame:
    """(set_id, pivot) of the sets that agree with a smaller set in enough of their minimal hashes.

    Pivots of pivots are followed once, so that a family mostly has one pivot; a set that stays its own pivot
    and has no members is in no family.
    """
    keys = sets.select("set_id", F.posexplode("keys").alias("j", "key"))
    least = keys.groupBy("j", "key").agg(F.min("set_id").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    votes = spread_join(keys, least, ["j", "key"], "inner", spread_by=["set_id"], bounded=True).where("set_id <> pivot")
    best = (
        votes.groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= FAMILY_VOTES)
        .groupBy("set_id").agg(F.min(F.struct(-F.col("votes"), "pivot")).alias("best"))
        .select("set_id", F.col("best.pivot").alias("pivot"))
    )
    best = written_once(best)
    up = best.select(F.col("set_id").alias("pivot"), F.col("pivot").alias("_up"))
    members = spread_join(best, up, ["pivot"], "left", spread_by=["set_id"], bounded=True).select(
        "set_id", F.coalesce("_up", "pivot").alias("pivot")
    ).where("set_id <> pivot")
    members = written_once(members)
    pivots = members.select("pivot").distinct()
    # a pivot that is a member elsewhere stays there only; its members keep it as pivot
    own = pivots.join(members.select(F.col("set_id").alias("pivot")), "pivot", "left_anti")
    return members.unionByName(own.select(F.col("pivot").alias("set_id"), "pivot"))


def size_block(n, percent: int):
    """Blocks of sizes: linked sets are in one block or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int")


def needed(a, b, percent: int):
    """:func:`least_shared` of columns."""
    return F.ceil((a + b) * percent / (100 + percent))


def most_unlike(a, b, percent: int):
    """Tokens that only one of two linked sets of these sizes may have."""
    return a + b - 2 * needed(a, b, percent)


def room_for(a, b, percent: int):
    """At least :func:`most_unlike` of sets up to these sizes; it grows with either."""
    return (a + b) * (100 - percent) / (100 + percent)


def first_pairs(entries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of pivots and single sets that the index cannot rule out: members of families are not looked up."""
    rows = entries.join(members.select("set_id"), "set_id", "left_anti")
    n, p = F.col("n"), F.col("p")
    small = rows.where(p <= n - needed(n, n, percent)).select(
        "token", size_block(n, percent).alias("block"), F.col("set_id").alias("a"), n.alias("an"), p.alias("ap"),
    )
    large = rows.select(
        "token", F.explode(F.array(size_block(n, percent), size_block(n, percent) - 1)).alias("block"),
        F.col("set_id").alias("b"), n.alias("bn"), p.alias("bp"),
    )
    fits = (
        ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b"))))
        & (F.col("an") * 100 >= F.col("bn") * percent)
        & (F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= needed(F.col("an"), F.col("bn"), percent))
    )
    return small.join(large, ["token", "block"]).where(fits).select("a", "an", "b", "bn").distinct()


def family_pairs(entries: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of families, by their pivots, with sets in two components that the index cannot rule out.

    A set without a family is one by itself; one of the two has members.  Lists whose sets all have one label, or none of which is a
    member, are not walked, and lists of the same families are walked as one, with the best place that each family has.
    """
    own = members.select("set_id", F.col("pivot").alias("_pivot"))
    rows = spread_join(entries, own, ["set_id"], "left", spread_by=["token"], bounded=True)
    rows = spread_join(rows, labels.withColumnsRenamed({"node": "set_id"}), ["set_id"], "left", spread_by=["token"], bounded=True)
    n, best = F.col("n"), ["least", "most", "rest", "small", "member"]
    rows = rows.select(
        "token", size_block(n, percent).alias("block"), F.coalesce("_pivot", "set_id").alias("family"), F.coalesce("label", "set_id").alias("label"),
        n.alias("least"), n.alias("most"), (n - F.col("p")).alias("rest"), (F.col("p") <= n - needed(n, n, percent)).alias("small"),
        F.col("_pivot").isNotNull().alias("member"),
    )

    def merged(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key, "block", "family", "label").agg(F.min("least").alias("least"), *[F.max(c).alias(c) for c in best[1:]])

    parts = written_once(merged(rows, "token"))
    lists = parts.groupBy("token").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.max("member").alias("m"),
        F.xxhash64(F.bit_xor(F.xxhash64("block", "family", "label")), F.count(F.lit(1))).alias("list"),
    ).where("x <> y AND m").select("token", "list")
    walked = written_once(merged(parts.join(lists, "token"), "list"))
    small = walked.where("small").select("list", "block", *[F.col(c).alias(f"a_{c}") for c in ("family", "label", *best)])
    large = walked.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1))).select(
        "list", "block", *[F.col(c).alias(f"b_{c}") for c in ("family", "label", *best)]
    )
    fits = (
        (F.col("a_label") != F.col("b_label")) & (F.col("a_family") != F.col("b_family"))
        & (F.col("a_member") | F.col("b_member"))
        & (F.col("a_least") <= F.col("b_most")) & (F.col("a_most") * 100 >= F.col("b_least") * percent)
        & (F.least("a_rest", "b_rest") >= needed(F.col("a_least"), F.col("b_least"), percent))
    )
    found = small.join(large, ["list", "block"]).where(fits)
    return found.select(F.least("a_family", "b_family").alias("a"), F.greatest("a_family", "b_family").alias("b")).distinct()


def pivots_within_reach(pairs: DataFrame, families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) of families whose pivots do not differ in more parities than their sets leave room for."""
    reach = families.groupBy("family").agg(F.max("unlike").alias("reach"), F.max("n").alias("most"))
    for x in ("a", "b"):
        sized = reach.select(F.col("family").alias(x), F.col("reach").alias(f"{x}r"), F.col("most").alias(f"{x}n"))
        pairs = spread_join(pairs, sized, [x], "inner", spread_by=["a", "b"], bounded=True)
    room = F.col("ar") + F.col("br") + room_for(F.col("an"), F.col("bn"), percent)
    return unlike_parities(pairs, sets, percent, room)


def joint_families(pivots: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """(pivot, set_id): the sets of two families that may be linked, under the pivot of the larger; ``pivots`` has (a, b, unlike).

    ``families`` has (family, set_id, n, unlike) with the differences from the pivot.  By the triangle inequality two
    sets differ in at least as much as their pivots do, less what either differs from its own.  The larger family
    is there once for all that are near it, so a pair makes as many rows as its smaller family has sets.
    """
    sized = families.groupBy("family").agg(F.max("unlike").alias("reach"), F.max("n").alias("most"), F.count(F.lit(1)).alias("sets"))
    pairs = pivots.withColumnRenamed("unlike", "far")
    for x in ("a", "b"):
        own = sized.select(F.col("family").alias(x), F.struct("sets", F.col("family").alias("family"), "reach", "most").alias(f"_{x}"))
        pairs = spread_join(pairs, own, [x], "inner", spread_by=["a", "b"], bounded=True)
    pairs = pairs.select("far", F.greatest("_a", "_b").alias("hub"), F.least("_a", "_b").alias("leaf"))
    leaves = pairs.select(
        F.col("hub.family").alias("pivot"), F.col("leaf.family").alias("family"), (F.col("far") - F.col("hub.reach")).alias("near"), F.col("hub.most").alias("most")
    )
    hubs = pairs.groupBy(F.col("hub.family").alias("pivot")).agg(
        F.min(F.col("far") - F.col("leaf.reach")).alias("near"), F.max("leaf.most").alias("most")
    ).select("pivot", F.col("pivot").alias("family"), "near", "most")
    room = room_for(F.col("n"), F.least(F.col("most"), F.floor(F.col("n") * 100 / percent)), percent)
    rows = written_once(leaves.unionByName(hubs)).join(families.select("family", "set_id", "n", "unlike"), "family")
    return rows.where(F.col("near") - F.col("unlike") <= room).select("pivot", "set_id").distinct()


def unlike_parities(pairs: DataFrame, sets: DataFrame, percent: int, room=None) -> DataFrame:
    """``pairs`` without those that differ in more parities than linked sets can, or than ``room``."""
    parity = sets.select("set_id", "parity")
    rows = spread_join(pairs, parity.withColumnsRenamed({"set_id": "a", "parity": "pa"}), ["a"], "inner", spread_by=["b"], bounded=True)
    rows = spread_join(rows, parity.withColumnsRenamed({"set_id": "b", "parity": "pb"}), ["b"], "inner", spread_by=["a"], bounded=True)

    def folded(p: str, other: str):
        """Half as many classes, when the other set has that."""
        half = (F.size(p) / 2).cast("int")
        both = F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(p) > F.size(other), both).otherwise(F.col(p))

    unlike = F.aggregate(
        F.zip_with(folded("pa", "pb"), folded("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    most = most_unlike(F.col("an"), F.col("bn"), percent) if room is None else room
    return rows.where(unlike <= most).select("a", "b")


# whole sets of the documents that need them


def filter_bits(ids: DataFrame) -> np.ndarray:
    """A filter of ``ids`` with ``FILTER_BITS`` bits, two per id; that many bits come to the driver."""
    spots = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(FILTER_BITS)) for i in (1, 2)])).alias("spot"))
    words = spots.groupBy((F.col("spot") / 32).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 32 AS int))")).alias("bits")
    )
    found = np.zeros(FILTER_BITS // 32, np.uint32)
    rows = words.toPandas()
    found[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return found


def with_spots(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FILTER_BITS)).alias("s1"),
        F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(FILTER_BITS)).alias("s2"), "doc_id", "text",
    )


def whole_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set_id, tokens) of the wanted sets, each from one document that has it.

    A bounded filter lets the scan skip other texts before anything is exchanged; what passes
    by chance is taken out by the join that follows.
    """
    holders = written_once(
        spread_join(rows.select("set_id", "doc_id"), wanted.withColumn("_w", F.lit(1)), ["set_id"], "inner", spread_by=["doc_id"], bounded=True)
        .groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    )
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits(holders))

    def compute(batches):
        bits, seen = shared.value, set()

        def passing():
            for batch in batches:
                spots = [batch.column(i).to_numpy() for i in (0, 1)]
                hit = np.ones(batch.num_rows, bool)
                for s in spots:
                    hit &= (bits[s // 32] >> (s % 32).astype(np.uint32) & 1).astype(bool)
                some = batch.filter(pa.array(hit))
                yield pa.record_batch([some.column(2), some.column(3)], names=["doc_id", "text"])

        pack = zstandard.ZstdCompressor(level=1)
        for _, s in sets_in(passing(), k):
            if len(s) and (own := set_id(s)) not in seen:
                seen.add(own)
                yield pa.record_batch([pa.array([own], pa.int64()), pa.array([pack.compress(s.tobytes())], pa.binary())], names=["set_id", "tokens"])

    found = with_spots(docs).mapInArrow(gives_back(compute), "set_id long, tokens binary")
    sets = written_once(found.join(holders.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))
    shared.destroy()
    return sets


def unpacked(tokens: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens.as_py()), np.uint64)


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return with_sets(pairs, tokens).mapInArrow(check, "a long, b long")


def with_sets(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their whole sets x and y."""
    rows = pairs.join(tokens.withColumnsRenamed({"set_id": "a", "tokens": "x"}), "a")
    return rows.join(tokens.withColumnsRenamed({"set_id": "b", "tokens": "y"}), "b").select("a", "b", "x", "y")


def pair_differences(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``unlike``, the number of tokens that only one of the two sets has."""

    def count(batches):
        for batch in batches:
            sets = [(unpacked(x), unpacked(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            unlike = [len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(unlike, pa.int64())], names=["a", "b", "unlike"])

    return with_sets(pairs, tokens).mapInArrow(gives_back(count), "a long, b long, unlike long")


# answers inside families


def differences(family: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pivot, set_id, size, n, unlike, lacks, beyond): members as differences from their pivot, ``unlike`` tokens in all."""

    def differ(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for x, r in zip(batch.column(2), batch.column(3), strict=True):
                x, r = unpacked(x), unpacked(r)
                lacks, beyond = np.setdiff1d(r, x, True), np.setdiff1d(x, r, True)
                out.append((len(r), len(x), len(lacks) + len(beyond), pack.compress(lacks.tobytes()), pack.compress(beyond.tobytes())))
            size, n, unlike, lacks, beyond = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in (size, n, unlike)], pa.array(lacks, pa.binary()), pa.array(beyond, pa.binary())],
                names=["pivot", "set_id", "size", "n", "unlike", "lacks", "beyond"],
            )

    rows = family.join(tokens.withColumnRenamed("tokens", "x"), "set_id")
    rows = rows.join(tokens.withColumnsRenamed({"set_id": "pivot", "tokens": "r"}), "pivot").select("pivot", "set_id", "x", "r")
    return rows.mapInArrow(gives_back(differ), "pivot long, set_id long, size long, n long, unlike long, lacks binary, beyond binary")


def family_links(members: DataFrame, percent: int, chunk: int = FAMILY_CHUNK) -> DataFrame:
    """Links that connect the members of each family as all their links would.

    Members are dealt into chunks by hash, and every two chunks of a family meet in one task.
    """
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).select(
        "pivot", F.ceil(F.col("c") / chunk).cast("int").alias("chunks")
    )
    dealt = spread_join(members, sizes, ["pivot"], "inner", spread_by=["set_id"], bounded=True).withColumn(
        "chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    )
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    keyed = dealt.withColumn("other", F.explode(every)).withColumns(
        {"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}
    )

    def link(part: pa.Table) -> pa.Table:
        size = part["size"][0].as_py()
        ids, n = part["set_id"].to_numpy(), part["n"].to_numpy()
        lacks, beyond = [unpacked(x) for x in part["lacks"]], [unpacked(x) for x in part["beyond"]]
        nl, nb = np.array([len(x) for x in lacks]), np.array([len(x) for x in beyond])
        owners_l, owners_b = np.repeat(np.arange(len(ids)), nl), np.repeat(np.arange(len(ids)), nb)
        all_l, all_b = np.concatenate(lacks), np.concatenate(beyond)
        label, found = np.arange(len(ids)), []

        def join(i, others):
            """One link to each component among the others."""
            for to in np.unique(label[others]).tolist():
                if to != label[i]:
                    found.append((ids[i], ids[to]))
                    old, new = max(to, label[i]), min(to, label[i])
                    label[label == old] = new

        for i in np.argsort(nl + nb, kind="stable").tolist():
            need = least_shared(n[i], n, percent)
            lowest = size - nl[i] - nl  # in common even if the members lack different tokens
            sure = lowest >= need
            sure[i] = False
            join(i, np.flatnonzero(sure))
            highest = size - np.maximum(nl[i], nl) + np.minimum(nb[i], nb)
            if not ((label != label[i]) & (highest >= need)).any():
                continue
            same_l = np.bincount(owners_l[np.isin(all_l, lacks[i])], minlength=len(ids))
            same_b = np.bincount(owners_b[np.isin(all_b, beyond[i])], minlength=len(ids))
            both = lowest + same_l + same_b >= need
            both[i] = False
            join(i, np.flatnonzero(both))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return keyed.groupBy("pivot", "low", "high").applyInArrow(gives_back(link), "a long, b long")


@in_small_batches
def linked(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    The component's id is the smallest doc_id reachable.  Null, empty and blank texts have empty
    sets and are linked with nothing, so each is its own; repeated rows and equal sets are in one component; an
    empty table gives no rows; other columns are not read.
    """
    everything = written_once(measured(docs, k))
    rows = everything.where("slice = -1")
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    sets = written_once(rows.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity")))
    tasks = docs.rdd.getNumPartitions()
    counted = everything.where("slice >= 0").select("slice", F.col("n").alias("part"), F.col("counts").alias("data"))
    classes = frequency_classes(counted, tokens, tasks)
    entries = index_entries(docs, classes, k, percent, max(16, tasks))
    family = written_once(families(sets))
    members = family.where("set_id <> pivot")

    def passed(pairs: DataFrame) -> DataFrame:
        return written_once(unlike_parities(pairs, sets, percent))

    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id")))

    pairs = passed(first_pairs(entries, members, percent))
    kin = family.select("set_id").unionByName(family.select(F.col("pivot").alias("set_id")))
    whole = whole_sets(docs, rows, kin.unionByName(sides(pairs)).distinct(), k)
    differing = written_once(differences(family, whole))
    within = family_links(differing, percent)
    links = written_once(verified(pairs, whole, percent).unionByName(within))
    labels = written_once(components(links))
    near = written_once(family_pairs(entries, members, labels, percent))
    if not near.isEmpty():
        single = sides(near).distinct().join(members.select("set_id"), "set_id", "left_anti").join(sets.select("set_id", "n"), "set_id")
        kinds = single.select(F.col("set_id").alias("family"), "set_id", "n", F.lit(0).cast("long").alias("unlike")).unionByName(
            differing.where("set_id <> pivot").select(F.col("pivot").alias("family"), "set_id", "n", "unlike")
        )
        kinds = written_once(kinds)
        near = written_once(pivots_within_reach(near, kinds, sets, percent))
        more = whole_sets(docs, rows, sides(near).distinct().join(whole.select("set_id"), "set_id", "left_anti"), k)
        known = whole.unionByName(more)
        joint = written_once(joint_families(written_once(pair_differences(near, known)), kinds, percent))
        own = differing.join(joint, ["pivot", "set_id"], "left_semi")  # the larger family's differences are there
        rest = joint.join(differing.select("pivot", "set_id"), ["pivot", "set_id"], "left_anti")
        links = links.unionByName(written_once(family_links(written_once(own.unionByName(differences(rest, known))), percent)))
    labels = written_once(components(written_once(links)))
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    renamed = spread_join(named.where("n_shingles > 0"), labels.withColumnRenamed("node", "set_id"), ["set_id"], "left", spread_by=["doc_id"], bounded=True)
    placed = written_once(renamed.select("doc_id", "n_shingles", F.coalesce("label", "set_id").alias("label")))
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = spread_join(placed, least, ["label"], "inner", spread_by=["doc_id"], bounded=True).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of every component.

    Documents without words stay, as do documents without an id.  Of rows that repeat an id of a component, the
    first by all columns stays.
    """
    columns = docs.columns
    found = written_once(linked(docs, k, percent))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(written_once(gone)), "doc_id", "left_anti").select(*columns)
    repeated = found.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = written_once(repeated)
    if not repeated.take(1):
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(once.select("_row.*").select(*columns))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return linked(table(spark, sf_dir, "documents"))
