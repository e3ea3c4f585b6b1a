r"""Choosing papers: title filter, time windows, citations, clusters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgauge.functions.json import object_fields
from corpusgauge.functions.ranking import top_per_group
from corpusgauge.functions.text import strip
from corpusgauge.operators.judging import fill, judge_apply
from corpusgauge.session import written_once

# Fine categories under each coarse one, in order of processing.
CATEGORY_PARTS = {
    "cs": ["cs"],
    "stat": ["stat"],
    "physics": [
        "astro-ph", "cond-mat", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "math-ph", "nlin",
        "nucl-ex", "nucl-th", "physics", "quant-ph",
    ],
    "math": ["math"],
    "q-bio": ["q-bio"],
    "q-fin": ["q-fin"],
    "eess": ["eess"],
    "econ": ["econ"],
}

# Phrases that rule a title out, and phrases that let a paper in.
BAD_PHRASES = [
    "code reviewer", "reviewer assignment", "reviewer selection", "peer review", "peer-review",
    "reviewing system", "review process", "reviewer recommendation",
]
GOOD_PHRASES = [
    "a survey of", "an overview of", "a review of", "this survey", "this review",
    "comprehensive review", "comprehensive survey", "this paper surveys", "this paper reviews",
    "literature review", "review and prospect", "survey and taxonomy", "survey and analysis",
    "state of the art", "state-of-the-art review", "systematic review", "meta-analysis",
    "comparative study", "comparative analysis", "critical review", "tutorial survey",
    "empirical review", "empirical survey", "recent advances in", "recent progress in",
    "progress and challenges", "trends and challenges", "past, present and future",
    "perspectives and challenges", "review and future directions", "survey and future directions",
    "review and opportunities", "survey and opportunities", "review and trends",
    "survey and trends", "review and challenges", "survey and challenges",
    "review and perspectives", "survey and perspectives", "review and roadmap",
    "survey and roadmap", "review and outlook", "survey and outlook",
]

WINDOW_DAYS = 365
MAX_WINDOWS = 10


def _any_of(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def survey_title_filter(papers: DataFrame) -> DataFrame:
    """Papers that look like surveys by title or summary.

    The one-element arrays give the lower-case text a name, so it is made
    once per row and not once per phrase.
    """
    good = F.exists(F.array(F.lower("title"), F.lower("summary")), lambda t: _any_of(t, GOOD_PHRASES))
    bad = F.exists(F.array(F.lower("title")), lambda t: _any_of(t, BAD_PHRASES))
    return papers.filter(~bad & good)


def coarse_category(fine: Column) -> Column:
    """The coarse category of a fine one such as ``cs.AI``."""
    archive = F.split_part(fine, F.lit("."), F.lit(1))
    pairs = [F.lit(x) for coarse, parts in CATEGORY_PARTS.items() for part in parts for x in (part, coarse)]
    return F.create_map(*pairs)[archive]


def category_rollup(papers: DataFrame) -> DataFrame:
    return papers.withColumn("category", coarse_category(F.col("fine_category")))


def paper_id(url: Column) -> Column:
    """Last segment of the address, cut at its first ``v``."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("v"), F.lit(1))


def paper_ids(papers: DataFrame, url: str = "url") -> DataFrame:
    return papers.withColumn("arxiv_id", paper_id(F.col(url)))


def time_bounds(now: dt.datetime, months_start: int = 36, months_end: int = 3) -> tuple[dt.datetime, dt.datetime]:
    """Start and end of the search, in months of 30 days before ``now``."""
    return now - dt.timedelta(days=30 * months_start), now - dt.timedelta(days=30 * months_end)


def _moment(at: dt.datetime) -> Column:
    """``at`` as a timestamp of the session's time zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def papers_in_window(papers: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Survey papers published between the bounds, each id once (the newest)."""
    inside = papers.filter(F.col("published").cast("timestamp").between(_moment(start), _moment(end)))
    return _once(survey_title_filter(inside), ["arxiv_id"])


def _once(papers: DataFrame, keys: list[str], *first: Column) -> DataFrame:
    """One row per key: by ``first``, then newest, lowest title, lowest other values."""
    rest = [c for c in papers.columns if c not in keys]
    # min/max over a struct is partially aggregated, so copies of one id fold early
    rank = F.struct(
        *[c.alias(f"_f{n}") for n, c in enumerate(first)],
        (-F.unix_micros(F.col("published").cast("timestamp"))).alias("_age"), F.col("title").alias("_title"),
        F.struct(*rest).alias("_rest"),
    )
    best = papers.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("p"))
    return best.select(*keys, "p.*")


def _most_cited() -> list[Column]:
    return [F.col("citation_count").desc(), F.col("arxiv_id")]


def top_cited(
    papers: DataFrame,
    now: dt.datetime,
    num: int = 50,
    held: DataFrame | None = None,
    order: Sequence[str] = tuple(CATEGORY_PARTS),
    max_windows: int = MAX_WINDOWS,
    allow_cross_category: bool = False,
) -> DataFrame:
    """The ``num`` most cited survey papers per category.

    The search starts 36 to 3 months before ``now`` and goes back a year at a
    time, at most ``max_windows`` windows, while a category has fewer than it
    needs.  An id seen for an earlier category in ``order``, chosen or not, is
    not available to a later one.  ``held`` (category, arxiv_id) are papers a
    category already has: they lower its need and are not new anywhere later.

    How far one category goes back depends on those before it, but only
    through counts per window: the driver sees a dozen numbers per category.  The ids are counted once, by the pattern
    of their windows in all categories.
    """
    start, end = time_bounds(now)
    ranks = {c: n for n, c in enumerate(order)}
    late, first, last = F.col("published").cast("timestamp"), _moment(start), _moment(end)
    gap = (F.unix_micros(first) - F.unix_micros(late)) / F.lit(WINDOW_DAYS * 86_400_000_000)
    window = F.when(late > last, None).when(late >= first, 0).otherwise(F.ceil(gap).cast("int"))
    listed = (
        survey_title_filter(category_rollup(papers))
        .withColumn("window", window)
        .filter((F.col("window") < max_windows) & F.col("category").isin(list(order)))
    )
    found = _once(listed, ["category", "arxiv_id"], F.col("window"))

    # one row per id: the window in which each category sees it
    seen = found.groupBy("arxiv_id").agg(
        *[F.min(F.when(F.col("category") == c, F.col("window"))).alias(f"w{n}") for c, n in ranks.items()]
    )
    if held is not None:
        marks = held.filter(F.col("category").isin(list(order))).groupBy("arxiv_id").agg(
            *[F.max(F.col("category") == c).alias(f"h{n}") for c, n in ranks.items()]
        )
        seen = seen.join(marks, "arxiv_id", "full")
    else:
        seen = seen.withColumns({f"h{n}": F.lit(False) for n in ranks.values()})
    seen = written_once(seen)
    # ids alike in all categories are one row of the table that the loop below reads
    marks = [f"{x}{n}" for x in "wh" for n in ranks.values()]
    patterns = written_once(seen.groupBy(*marks).agg(F.count("*").alias("ids")))

    needs: list[int] = []
    reach: list[int] = []

    def free(n: int) -> Column:
        """Window of the id for category ``n`` unless it was seen before."""
        taken = F.coalesce(F.col(f"h{n}"), F.lit(False))
        for m in range(n):
            taken = taken | F.coalesce(F.col(f"h{m}"), F.lit(False))
            if not allow_cross_category:
                taken = taken | F.coalesce(F.col(f"w{m}") <= reach[m], F.lit(False))
        return F.when(~taken, F.col(f"w{n}"))

    have = {}
    if held is not None:
        per_category = held.groupBy("category").agg(F.count_distinct("arxiv_id").alias("n"))
        have = {r.category: r.n for r in per_category.filter(F.col("category").isin(list(order))).collect()}
    for c, n in ranks.items():
        needs.append(max(num - have.get(c, 0), 0))
        if needs[n] == 0:
            reach.append(-1)
            continue
        # at most one row per window comes back
        sizes = {r.w: r.n for r in patterns.groupBy(free(n).alias("w")).agg(F.sum("ids").alias("n")).collect()}
        total, far = 0, max_windows - 1
        for w in range(max_windows):
            total += sizes.get(w, 0)
            if total >= needs[n]:
                far = w
                break
        reach.append(far)

    owned = F.array(
        *[
            F.when(free(n) <= reach[n], F.struct(F.lit(c).alias("category"), F.lit(needs[n]).alias("need")))
            for c, n in ranks.items()
        ]
    )
    fetched = seen.select(
        "arxiv_id", F.inline(F.filter(owned, lambda o: o.isNotNull()))
    )
    ranked = top_per_group(found.join(fetched, ["category", "arxiv_id"]), ["category"], _most_cited(), num)
    return ranked.filter(F.col("rank") <= F.col("need")).drop("need")


def existing_exclude(
    candidates: DataFrame, held: DataFrame, num: int = 50
) -> DataFrame:
    """New papers per category up to ``num`` less those already held."""
    have = held.groupBy("category").agg(F.count_distinct("arxiv_id").alias("have"))
    new = candidates.join(held.select("category", "arxiv_id").distinct(), ["category", "arxiv_id"], "left_anti")
    ranked = top_per_group(new, ["category"], _most_cited(), num)
    need = F.lit(num) - F.coalesce("have", F.lit(0))
    return ranked.join(have, "category", "left").filter(F.col("rank") <= need).drop("have")


def merge_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Papers per topic: the old ones in their order, then unseen new ones.

    Inputs have ``topic, pos, arxiv_id, title``; ``source`` 0 is old.
    """
    both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    kept = both.groupBy("topic", "arxiv_id").agg(
        F.min(F.struct("source", "pos", "title")).alias("p")
    )
    return kept.select("topic", "arxiv_id", "p.source", "p.pos", "p.title")


LABEL_TEMPLATE = (
    "Papers:\n{papers}\nGive each paper a short topic label of its own. Answer as JSON, "
    'label to list of {{"title": ..., "arxiv_id": ...}}.'
)


def title_batches(papers: DataFrame, size: int = 10, key: str = "category", buckets: int = 1) -> DataFrame:
    """Prompts for batches of ``size`` papers of one category.

    A category is cut into ``buckets`` by a hash of the id, so that none need be
    ordered as a whole in one task; only the last batch of a bucket is short.
    The number is the caller's and does not follow the data: a batch depends
    on the papers of its bucket alone.
    """
    bucket = F.pmod(F.xxhash64("arxiv_id"), F.lit(buckets))
    counted = papers.select(key, "arxiv_id", "title")
    place = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("arxiv_id")) - 1
    numbered = counted.withColumn("bucket", bucket).withColumn("batch_no", F.floor(place / size))
    listed = F.array_sort(F.collect_list(F.struct("arxiv_id", "title")))
    return numbered.groupBy(key, "bucket", "batch_no").agg(
        F.to_json(listed).alias("papers"), F.count("*").alias("n")
    ).select(key, "bucket", "batch_no", "n", "papers", fill(LABEL_TEMPLATE).alias("prompt"))


def assign_topics(papers: DataFrame, scorer, size: int = 10, attempts: int = 3, buckets: int = 1) -> DataFrame:
    """Topic labels from the judge: one row per label and paper."""
    batches = title_batches(papers, size, buckets=buckets).drop("papers")
    answers = judge_apply(batches, scorer, attempts)
    labels = answers.select("category", F.explode(object_fields(F.col("raw"))).alias("label", "members"))
    members = F.from_json("members", "array<struct<title:string,arxiv_id:string>>")
    return labels.select("category", strip(F.col("label")).alias("topic"), F.explode(members).alias("m")).select(
        "category", "topic", "m.arxiv_id", "m.title"
    )
