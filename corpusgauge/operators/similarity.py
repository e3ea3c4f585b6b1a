r"""Nearest ground-truth items and similarity means.

Items of a topic and facet meet in blocks: a block of queries against a block
of ground truth is one matrix product inside one task, which hands on only
the best ``k`` rows per query.  A topic with a third of all items is many
blocks on many tasks, and no pair of items ever becomes a row.

Blocks of a large topic hold what lies around one pivot.  The triangle
inequality rules out pairs of blocks that are too far apart to hold any of the
best ``k``, before their vectors travel; the result stays exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.schema import BASELINE, TOP_ITEMS
from corpusgauge.session import written_once

#: Items of a block at most, unless a caller asks for more.
BLOCK = 2048
#: Blocks of a group up to which its blocks grow with it.
FEW_BLOCKS = 8
#: Most pivots of a topic and facet; beyond, what lies around a pivot is cut into blocks by id.
PIVOTS = 64
#: Stored vectors of a topic and facet that pivots are chosen from.
CANDIDATES = 256
SLACK = 1e-9


def _large_groups(queries: DataFrame, stored: DataFrame, group: list[str], size: int) -> DataFrame:
    """Number of blocks per group on either side, where it is more than one; 0 where a side has no items.

    ``size`` is the least size of a block: an item travels once per block that it meets, so a side of more than
    ``FEW_BLOCKS`` such blocks has larger ones, of up to ``BLOCK`` items.
    """
    rows = queries.select(*group, F.lit(1).alias("q"), F.lit(0).alias("s")).unionByName(
        stored.select(*group, F.lit(0).alias("q"), F.lit(1).alias("s"))
    )
    counts = rows.groupBy(*group).agg(F.sum("q").alias("q"), F.sum("s").alias("s"))

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / _block_size(F.col(n), size)).cast("int").alias(f"{n}_blocks")

    return counts.select(*group, blocks("q"), blocks("s")).filter("q_blocks > 1 OR s_blocks > 1")


def _block_size(items: Column, size: int) -> Column:
    return F.greatest(F.lit(size), F.least(F.lit(BLOCK), F.ceil(items / FEW_BLOCKS)))


def _pivots(stored: DataFrame, large: DataFrame, group: list[str], metric: str) -> DataFrame:
    """One row per large group: its numbers of blocks and up to ``PIVOTS`` of its stored vectors.

    Candidates are the first of a group by the hash of their id; each pivot is the candidate farthest from those
    before it, so any first few of them lie apart.  Where angles count they are unit vectors.
    """
    order = Window.partitionBy(*group).orderBy(F.xxhash64("near_id"), "near_id")
    first = stored.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= CANDIDATES)
    listed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_no", "s_embedding"))).alias("_listed"))
    joined = large.join(listed, group).select(*large.columns, F.col("_listed.s_embedding").alias("_pivots"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])

    def chosen(batches):
        for batch in batches:
            yield batch.assign(_pivots=[_spaced(v, metric) for v in batch["_pivots"]])

    return joined.mapInPandas(chosen, schema + ", _pivots array<array<double>>")


def _spaced(vectors, metric: str) -> list[list[float]]:
    rows = _scaled(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]), metric)
    picks, away = [0], np.linalg.norm(rows - rows[0], axis=1)
    while len(picks) < PIVOTS and away.max() > 0:
        picks.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(rows - rows[picks[-1]], axis=1))
    return rows[picks].tolist()


def _points(pivots, blocks: int) -> np.ndarray:
    """The pivots of a side: as many as it has blocks."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in pivots[:blocks]])


def _scaled(rows: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return rows
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _around_pivots(
    items: DataFrame, pivots: DataFrame, group: list[str], ids: list[str], vector: str, blocks: str, metric: str
) -> DataFrame:
    """Items of large groups with ``_cell``, their nearest pivot, and ``_away``, the distance to it.

    Distances are Euclidean, of unit vectors for angles.  A zero vector has no
    angle: it goes to a cell of its own that is infinitely wide.
    """
    split = F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.col(blocks)).cast("int")
    sizes = pivots.select(*group, blocks)
    dealt = spread_join(items, sizes, group, "inner", spread_by=ids).withColumn("_split", split).drop(blocks)
    centres = pivots.select(*group, blocks, "_pivots", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("_split"))
    names = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", _cell int, _away double"

    def place(rows: pd.DataFrame, centre: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centre.empty:
            return pd.DataFrame(columns=[*names, "_cell", "_away"])
        points = _points(centre["_pivots"].iloc[0], int(centre[blocks].iloc[0]))
        vectors = _scaled(np.stack(rows[vector].to_numpy()).astype(np.float64), metric)
        away = np.stack([np.linalg.norm(vectors - p, axis=1) for p in points], axis=1)
        cell, nearest = away.argmin(axis=1), away.min(axis=1)
        if metric == "cosine":
            zero = ~vectors.any(axis=1)
            cell, nearest = np.where(zero, len(points), cell), np.where(zero, np.inf, nearest)
        return rows[names].assign(_cell=cell.astype(np.int32), _away=nearest)

    return dealt.groupBy(*group, "_split").cogroup(centres.groupBy(*group, "_split")).applyInPandas(place, schema)


def _open_pairs(q_points, s_points, q_cells, s_cells, k: int) -> np.ndarray:
    """Which cells of queries (rows) may find one of their ``k`` nearest in which cells of stored items.

    Cells are (number, items, radius).  A query's ``k``-th nearest is no farther than the farthest
    item of the nearest cells that hold ``k`` items together.
    """
    apart = np.zeros((len(q_cells), len(s_cells)))
    for i, (a, _, _) in enumerate(q_cells):
        for j, (b, _, _) in enumerate(s_cells):
            if a < len(q_points) and b < len(s_points):
                apart[i, j] = np.linalg.norm(q_points[a] - s_points[b])
    wide = np.array([r for _, _, r in q_cells])[:, None] + np.array([r for _, _, r in s_cells])[None, :]
    low, high = np.maximum(apart - wide, 0.0), apart + wide
    items = np.array([n for _, n, _ in s_cells])
    found = np.zeros(low.shape, dtype=bool)
    for i in range(len(q_cells)):
        order = np.argsort(high[i])
        enough = np.searchsorted(np.cumsum(items[order]), k)
        bound = high[i][order[enough]] ** 2 if enough < len(order) else np.inf
        found[i] = low[i] ** 2 <= bound + SLACK * (1.0 + bound)
    return found


PLAN = "side string, _cell int, own_cell int, own_blocks int, others array<struct<cell:int,blocks:int>>"


def _plan(cells: DataFrame, pivots: DataFrame, group: list[str], k: int, block: int) -> DataFrame:
    """Per cell: how many blocks it has, and the cells of the other side, with theirs, that it meets.

    One row per group goes in, of at most twice ``PIVOTS`` cells.  Where the bounds leave more copies of
    vectors than blocks by id would need, all of the group is one cell, -1, and its blocks are by id.
    """
    listed = cells.groupBy(*group).agg(F.collect_list(F.struct("side", "_cell", "n", "radius")).alias("_cells"))
    joined = pivots.join(listed, group)
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in group) + ", " + PLAN

    def planned(batches):
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                side = {s: sorted((c["_cell"], c["n"], c["radius"]) for c in r["_cells"] if c["side"] == s) for s in "qs"}
                blocks = {"q": int(r["q_blocks"]), "s": int(r["s_blocks"])}
                points = {s: _points(r["_pivots"], blocks[s]) for s in "qs"}
                open_pairs = _open_pairs(points["q"], points["s"], side["q"], side["s"], k)
                number = {s: np.array([n for _, n, _ in side[s]]) for s in "qs"}
                size = {s: max(block, min(BLOCK, -(-int(number[s].sum()) // FEW_BLOCKS))) for s in "qs"}
                cut = {s: -(-number[s] // size[s]) for s in "qs"}
                copies = (open_pairs * (number["q"][:, None] * cut["s"] + cut["q"][:, None] * number["s"])).sum()
                by_id = copies > number["q"].sum() * blocks["s"] + number["s"].sum() * blocks["q"]
                for s, t, met in (("q", "s", open_pairs), ("s", "q", open_pairs.T)):
                    for i, (cell, _, _) in enumerate(side[s]):
                        others = [{"cell": int(side[t][j][0]), "blocks": int(cut[t][j])} for j in np.flatnonzero(met[i])]
                        own = (-1, blocks[s], [{"cell": -1, "blocks": blocks[t]}]) if by_id else (cell, int(cut[s][i]), others)
                        rows.append((*[r[c] for c in group], s, cell, *own))
            yield pd.DataFrame(rows, columns=[*group, "side", "_cell", "own_cell", "own_blocks", "others"])

    return joined.mapInPandas(planned, schema)


PAIR = ["q_cell", "q_block", "s_cell", "s_block"]


def _dealt(
    queries: DataFrame, stored: DataFrame, group: list[str], ids: list[str], k: int, metric: str, block: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the pairs of blocks they belong to, an item once per block of the other side that it meets.

    ``stored`` has the group's columns, ``near_id`` and ``s_embedding``.  A block follows from the item's own values, so
    a repeated task rebuilds it.  A pair of blocks has a key, and so a task, of its own.
    """
    counted = written_once(_large_groups(queries, stored, group, block))
    # as a rule few groups are large: their list is then broadcast, on a count
    listed = broadcast_if_small(counted)
    one = {c: F.lit(0) for c in PAIR}
    if counted.isEmpty():
        return queries.withColumns(one), stored.withColumns(one)
    # where the stored side is one block every query meets all of it, and pivots would rule nothing out
    wide, large = counted.filter("s_blocks = 1"), listed.filter("s_blocks > 1")
    by_id = F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.col("q_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))

    def apart(items: DataFrame, by: list[str], q_block: Column) -> DataFrame:
        met = spread_join(items, wide.select(*group, "q_blocks"), group, "inner", spread_by=by)
        dealt = met.withColumns({c: F.lit(0) for c in PAIR if c != "q_block"}).withColumn("q_block", q_block)
        return items.join(listed, group, "left_anti").withColumns(one).unionByName(dealt.select(*items.columns, *PAIR))

    small_q, small_s = apart(queries, ids, by_id), apart(stored, ["near_id"], every)
    if counted.filter("s_blocks > 1").isEmpty():
        return small_q, small_s
    big_q, big_s = (items.join(large, group, "left_semi") for items in (queries, stored))
    # items of large groups without any item on the other side go no further
    pivots = written_once(_pivots(big_s, large.filter("q_blocks > 0"), group, metric))
    near_q = written_once(_around_pivots(big_q, pivots, group, ids, "embedding", "q_blocks", metric))
    near_s = written_once(_around_pivots(big_s, pivots, group, ["near_id"], "s_embedding", "s_blocks", metric))
    cells = [
        df.groupBy(*group, "_cell").agg(F.count("*").alias("n"), F.max("_away").alias("radius")).withColumn("side", F.lit(side))
        for side, df in (("q", near_q), ("s", near_s))
    ]
    plan = written_once(_plan(cells[0].unionByName(cells[1]), pivots, group, k, block))

    def sent(items: DataFrame, columns: list[str], own: str, other: str, by: list[str]) -> DataFrame:
        mine = plan.filter(F.col("side") == own).drop("side")
        met = spread_join(items, mine, [*group, "_cell"], "inner", spread_by=by)
        return met.select(
            *columns, F.col("own_cell").alias(f"{own}_cell"),
            F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.col("own_blocks")).cast("int").alias(f"{own}_block"),
            F.explode("others").alias("_other"),
        ).select(
            *columns, f"{own}_cell", f"{own}_block", F.col("_other.cell").alias(f"{other}_cell"),
            F.explode(F.sequence(F.lit(0), F.col("_other.blocks") - 1)).alias(f"{other}_block"),
        )

    return (
        small_q.unionByName(sent(near_q, queries.columns, "q", "s", ids)),
        small_s.unionByName(sent(near_s, stored.columns, "s", "q", ["near_id"])),
    )


def _cosine(products: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distances by angle; a zero vector has similarity 0 to every other."""
    return 1.0 - np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)


def _distances(rows: np.ndarray, one: np.ndarray, metric: str) -> np.ndarray:
    """Distances of ``rows`` from one vector, summed directly."""
    if metric == "cosine":
        return _cosine(rows @ one, np.linalg.norm(rows, axis=1) * np.linalg.norm(one))
    return ((rows - one) ** 2).sum(axis=1)


def _best(queries: np.ndarray, truth: np.ndarray, ids: np.ndarray, k: int, metric: str):
    """For each query (positions of, distances to) its ``k`` nearest, ties by id.

    The matrix product finds the candidates up to rounding; their distances
    are then summed directly, so equal vectors stay equal.  Queries without a candidate too many are done at once.
    """
    if metric == "cosine":
        scale = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(truth, axis=1)[None, :]
        rough = _cosine(queries @ truth.T, scale)
    else:
        rough = (queries**2).sum(1)[:, None] + (truth**2).sum(1)[None, :] - 2.0 * (queries @ truth.T)
    k = min(k, truth.shape[0])
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
    scale = 1.0 + np.abs(edge)
    close = rough <= (edge + SLACK * scale)[:, None]
    plain = (close.sum(axis=1) == k) & (metric == "l2sq")
    sorted_near = np.argsort(ids, kind="stable")
    at = np.nonzero(close[plain][:, sorted_near])[1].reshape(-1, k)
    at = sorted_near[at]  # by id, which a stable sort by distance keeps
    away = np.empty(at.shape)
    for j in range(k):
        away[:, j] = np.round(((truth[at[:, j]] - queries[plain]) ** 2).sum(axis=1), 12)
    order = np.argsort(away, axis=1, kind="stable")
    ready = zip(np.take_along_axis(at, order, axis=1), np.take_along_axis(away, order, axis=1))
    for q in range(queries.shape[0]):
        if plain[q]:
            yield next(ready)
            continue
        near = np.flatnonzero(close[q])
        exact = np.round(_distances(truth[near], queries[q], metric), 12)
        order = np.lexsort((ids[near], exact))[:k]
        yield near[order], exact[order]


def knn_query(
    queries: DataFrame,
    stored: DataFrame,
    k: int = 5,
    group: Sequence[str] = ("topic", "facet"),
    ids: Sequence[str] = ("item_no",),
    metric: str = "l2sq",
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` most similar stored items of every query item, exact.

    Both sides hold the group columns and ``embedding``; ``ids`` name a query
    item, ``item_no`` (bigint) a stored one.  Similarity is one minus the
    distance: squared Euclidean or cosine; a zero vector's cosine is 0.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    group, ids = list(group), list(ids)
    fresh = stored.select(*group, F.col("item_no").cast("bigint").alias("near_id"), F.col("embedding").alias("s_embedding"))
    left, right = _dealt(queries.select(*group, *ids, "embedding"), fresh, group, ids, k, metric, block)
    # fresh names: the stored items are often a part of the queries
    s_group = [f"s_{c}" for c in group]
    right = right.select(*[F.col(c).alias(f"s_{c}") for c in group], "near_id", "s_embedding", *[F.col(c).alias(f"s_{c}") for c in PAIR])

    named = [f for f in queries.schema.fields if f.name in [*group, *ids]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named)
    schema += ", near_id bigint, distance double"
    names = [f.name for f in named]

    def match(left_block: pd.DataFrame, right_block: pd.DataFrame) -> pd.DataFrame:
        if left_block.empty or right_block.empty:
            return pd.DataFrame(columns=[*names, "near_id", "distance"])
        q_vectors = np.stack(left_block["embedding"].to_numpy()).astype(np.float64)
        s_vectors = np.stack(right_block["s_embedding"].to_numpy()).astype(np.float64)
        s_ids = right_block["near_id"].to_numpy(dtype=np.int64)
        found = list(_best(q_vectors, s_vectors, s_ids, k, metric))
        out = left_block[names].loc[left_block.index.repeat([len(at) for at, _ in found])]
        return out.assign(
            near_id=np.concatenate([s_ids[at] for at, _ in found]),
            distance=np.concatenate([d for _, d in found]),
        )

    s_pair = [f"s_{c}" for c in PAIR]
    found = left.groupBy(*group, *PAIR).cogroup(right.groupBy(*s_group, *s_pair)).applyInPandas(match, schema)
    order = Window.partitionBy(*group, *ids).orderBy("distance", "near_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(*group, *ids, "rank", "near_id", (1 - F.col("distance")).alias("score"))
    )


def nn_similarity(
    items: DataFrame, baseline: str = BASELINE, metric: str = "l2sq", block: int = BLOCK
) -> DataFrame:
    """Score of every item against the nearest baseline item of its topic and facet.

    ``items`` has ``topic, system, facet, item_no, embedding``; the baseline's
    own items are scored as well.
    """
    truth = items.filter(F.col("system") == baseline)
    best = knn_query(items, truth, 1, ("topic", "facet"), ("system", "item_no"), metric, block)
    return best.select("topic", "system", "facet", "item_no", "score")


def topn_mean_similarity(
    scored: DataFrame,
    keys: Sequence[str] = ("topic", "system"),
    tops: Mapping[str, int] = TOP_ITEMS,
    docs: DataFrame | None = None,
) -> DataFrame:
    """Mean and list of the best scores per facet; 0 and empty without items.

    ``docs`` (keys) adds the facets of documents that have no items at all.
    """
    keys = list(keys)
    top = F.create_map(*[F.lit(x) for pair in tops.items() for x in pair])[F.col("facet")]
    order = Window.partitionBy(*keys, "facet").orderBy(F.col("score").desc(), "item_no")
    # the constant bound lets each task keep only that many rows per facet
    best = (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(tops.values()))
        .filter(F.col("rank") <= top)
    )
    means = best.groupBy(*keys, "facet").agg(
        F.avg("score").alias("mean_score"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]
        ).alias("scores"),
    )
    if docs is not None:
        names = F.array(*[F.lit(f) for f in tops])
        full = docs.select(*keys).distinct().withColumn("facet", F.explode(names))
        means = full.join(means, [*keys, "facet"], "left").select(
            *keys, "facet", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
            F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
        )
    return means


def sim_stale_facets(similarity: DataFrame) -> DataFrame:
    """Facets whose stored mean is 0: the list to compute again."""
    return similarity.filter(F.col("mean_score") == 0).drop("mean_score")
