"""The two long computations: documents to scores, documents to similarities.

Both are one plan up to the call of the model.  Answers are written to the
shared folder before anything reads them, since several metrics do and no
prompt should be paid for twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import broadcast_if_small
from corpusgauge.operators import citations as C
from corpusgauge.operators import claims as L
from corpusgauge.operators import documents as D
from corpusgauge.operators import judging as J
from corpusgauge.operators import metrics as M
from corpusgauge.operators import outline as O
from corpusgauge.operators import references as P
from corpusgauge.operators import rollup as R
from corpusgauge.operators import similarity as S
from corpusgauge.operators.ledger import judge_once
from corpusgauge.schema import BASELINE, CONTENT_CRITERIA, DOC_KEYS, FACET_METRICS, METRICS
from corpusgauge.session import written_once

KEYS = list(DOC_KEYS)
FACETS = tuple(FACET_METRICS)


def parsed_documents(docs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Keys, ``more``, ``heads``, ``main_content`` and ``ref_block``: all that the prompts are made of, in one row."""
    return D.split_content_refs(O.headings(docs, "md", [*KEYS, *more, "md"]), "md", [*KEYS, *more, "heads"])


def refined_outline(docs: DataFrame, scorer: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """Outlines, flat ones with the levels the model gives them."""
    return _refined(O.headings(docs, "md", KEYS), scorer, attempts)


def _refined(heads: DataFrame, scorer: Callable[[str], str], attempts: int, model: str = "default", ledger: str | None = None, **calls) -> DataFrame:
    texts = O.outline_lines(heads).filter("flat")
    asked = J.template_requests(texts, "outline_refine", KEYS, text=F.replace("text", F.lit("\n"), F.lit(",\n")))
    answers = written_once(_answers(asked, scorer, attempts, ledger, model, **calls))
    return O.apply_refinement(O.outline_rows(heads), answers)


def evaluation_requests(contents: DataFrame, outline: DataFrame) -> DataFrame:
    """All prompts for the documents of ``contents``, rows of :func:`parsed_documents`.

    Keys, ``facet``, ``task``, ``item_no``, ``depth``, ``max_depth`` and ``prompt``.
    """
    edges = O.outline_edges(O.outline_tree(outline))
    none = F.lit(None).cast("int")

    def asked(rows: DataFrame, facet: str, task: str, item=none, depth=none, deepest=none) -> DataFrame:
        return rows.select(
            *KEYS, F.lit(facet).alias("facet"), F.lit(task).alias("task"), item.cast("int").alias("item_no"),
            depth.alias("depth"), deepest.alias("max_depth"), "prompt",
        )

    def single(texts: DataFrame, facet: str) -> DataFrame:
        return J.criterion_requests(texts.select(*KEYS, F.lit(facet).alias("facet"), "text"))

    text = contents.select(*KEYS, F.col("main_content").alias("text"))
    block = contents.select(*KEYS, F.col("ref_block").alias("text"))
    cited = C.write_citations(C.citations(contents))
    listed = F.replace("references", F.lit(";"), F.lit("\n"))
    children = J.template_requests(edges, "children", [*KEYS, "parent_pos", "parent_level", "max_depth"])
    return (
        asked(single(O.outline_lines(contents), "outline"), "outline", "Outline")
        .unionByName(
            asked(children, "outline", "Outline_structure", F.col("parent_pos"), F.col("parent_level"), F.col("max_depth"))
        )
        .unionByName(asked(J.all_criteria_requests(text), "content", "content"))
        .unionByName(asked(J.template_requests(cited, "faithfulness", KEYS, references=listed), "content", "Faithfulness"))
        .unionByName(asked(single(block, "reference"), "reference", "Reference"))
        .unionByName(
            asked(J.template_requests(P.ref_batches(contents), "reference_batch", KEYS), "reference", "Reference_quality")
        )
    )


def scores_from_answers(docs: DataFrame, answers: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """Long scores of every document from parsed answers.

    A document without anything to judge gets 100 for its structure and 0 for
    the rest.
    """
    def of(task: str) -> DataFrame:
        return answers.filter(F.col("task") == task)

    def named(rows: DataFrame, metric: str) -> DataFrame:
        return rows.select(*KEYS, F.lit(metric).alias("metric"), "value")

    def graded(task: str, criteria: Sequence[str]) -> DataFrame:
        return J.judge_scores(of(task).select(*KEYS, "fields", "parsed"), criteria)

    parents = J.children_verdicts(
        of("Outline_structure").withColumnRenamed("item_no", "parent_pos"), [*KEYS, "parent_pos", "depth", "max_depth"]
    )
    found = (
        graded("Outline", ["Outline"])
        .unionByName(named(M.structure_score(parents, keys=KEYS), "Outline_structure"))
        .unionByName(graded("content", CONTENT_CRITERIA))
        .unionByName(named(M.faithfulness(J.support_verdicts(of("Faithfulness"), KEYS), KEYS, sentence=None), "Faithfulness"))
        .unionByName(graded("Reference", ["Reference"]))
        .unionByName(named(M.reference_quality(J.support_verdicts(of("Reference_quality"), KEYS), KEYS), "Reference_quality"))
    )
    wanted = [m for m in METRICS if any(m in FACET_METRICS[f] for f in facets)]
    default = F.when(F.col("metric") == "Outline_structure", 100.0).otherwise(0.0)
    every = docs.select(*KEYS, F.explode(F.array(*[F.lit(m) for m in wanted])).alias("metric"))
    both = every.withColumn("value", F.lit(None).cast("double")).unionByName(found)
    return both.groupBy(*KEYS, "metric").agg(F.max("value").alias("value")).withColumn(
        "value", F.coalesce("value", default)
    ).filter(F.col("metric").isin(wanted))


def evaluate_documents(
    docs: DataFrame,
    scorer: Callable[[str], str] = J.answer_by_digest,
    model: str = "default",
    done: DataFrame | None = None,
    attempts: int = 3,
    ledger: str | None = None,
    **calls,
) -> DataFrame:
    """Documents to long scores of ``model``.

    With ``done``, only facets with an absent metric are asked for again, and
    the new scores go over the old ones; a finished document is not parsed.  With ``ledger`` (a folder), a run that died
    is taken up where its last tasks ended; ``calls`` are the options of :func:`judging.judge_apply`.
    """
    options = {"ledger": ledger, **calls}
    if done is None:
        contents = written_once(parsed_documents(docs))
        requests = evaluation_requests(contents, _refined(contents, scorer, attempts, model, **options))
        return _scored(docs, requests, scorer, model, attempts, **options)
    mine = done.filter(F.col("model") == model)
    open_facet = [*KEYS, "facet"]
    pending = written_once(J.pending_work(docs.select(*KEYS, F.lit(model).alias("model")), mine).drop("model"))
    scores = _asked_again(docs, pending, open_facet, scorer, model, attempts, **options)
    facets = F.create_map(*[F.lit(x) for f, names in FACET_METRICS.items() for m in names for x in (m, f)])
    fresh = scores.withColumn("facet", facets[F.col("metric")]).join(pending, open_facet, "left_semi")
    return J.merge_scores(mine, fresh.drop("facet"))


def _asked_again(docs, work, what: list[str], scorer, model: str, attempts: int, **options) -> DataFrame:
    """Scores from the prompts of ``work`` alone (keys with ``facet`` or ``task``).

    Prompts and texts are long: a short list of open work goes to them, not they to it.
    """
    few = broadcast_if_small(work)
    some = docs.join(broadcast_if_small(work.select(*KEYS).distinct()), KEYS, "left_semi")
    contents = written_once(parsed_documents(some))
    outlined = work.filter(F.col(what[-1]).isin("outline", "Outline_structure")).select(*KEYS).distinct()
    outline = _refined(contents.join(broadcast_if_small(outlined), KEYS, "left_semi"), scorer, attempts, model, **options)
    requests = evaluation_requests(contents, outline).join(few, what, "left_semi")
    return _scored(some, requests, scorer, model, attempts, **options)


def supplement_scores(
    docs: DataFrame,
    scores: DataFrame,
    scorer: Callable[[str], str] = J.answer_by_digest,
    model: str = "default",
    attempts: int = 3,
) -> DataFrame:
    """``scores`` of ``model`` with another try at what a judge failed.

    Zeros are asked for again, and so is the content of a document that lacks
    any of its grades; an answer only goes where the score is zero or absent.
    """
    mine = written_once(scores.filter(F.col("model") == model))  # read twice; often a plan that parses every answer
    task = F.when(F.col("work") == "Content", F.lit("content")).otherwise(F.col("work"))
    work = written_once(J.missing_scores(mine).select(*KEYS, task.alias("task")))
    fresh = _asked_again(docs, work, [*KEYS, "task"], scorer, model, attempts)
    asked_for = F.when(F.col("metric").isin(list(CONTENT_CRITERIA)), F.lit("content")).otherwise(F.col("metric"))
    fresh = fresh.withColumn("task", asked_for).join(work, [*KEYS, "task"], "left_semi").drop("task")
    return J.merge_scores(mine, fresh, zeros_only=True)


def _answers(requests: DataFrame, scorer: Callable[[str], str], attempts: int, ledger: str | None, model: str, **calls) -> DataFrame:
    """Answers of the scorer, through a ledger if there is one."""
    if ledger is None:
        return J.judge_apply(requests, scorer, attempts, **calls)
    return judge_once(requests, scorer, ledger, model, attempts=attempts, **calls)


def _scored(
    docs: DataFrame, requests: DataFrame, scorer: Callable[[str], str], model: str, attempts: int, ledger: str | None = None, **calls
) -> DataFrame:
    answers = J.judge_parse(written_once(_answers(requests, scorer, attempts, ledger, model, **calls)))
    return scores_from_answers(docs, answers).select(*KEYS, F.lit(model).alias("model"), "metric", "value")


def comparison_verdicts(
    docs: DataFrame,
    scorer: Callable[[str], str],
    baseline: str = BASELINE,
    model: str = "default",
    done: DataFrame | None = None,
    attempts: int = 3,
    seed: int = 0,
) -> DataFrame:
    """Whether each document beats the baseline's on its topic: keys, model,
    ``metric`` (outline, content or reference), ``is_better``.

    Pairs with a verdict in ``done`` keep it and are not asked for again; a
    document whose pairs all have one is not parsed.
    """
    own = F.col("system") == baseline
    rows, stored = docs, None
    if done is not None:
        stored = done.filter(F.col("model") == model).select(*KEYS, "model", "metric", "is_better")
        finished = stored.groupBy(*KEYS).agg(F.countDistinct("metric").alias("n")).filter(F.col("n") >= len(FACETS))
        open_docs = docs.filter(~own).join(finished.select(*KEYS), KEYS, "left_anti")
        topics = broadcast_if_small(written_once(open_docs.select("category", "topic").distinct()))
        rows = open_docs.unionByName(docs.filter(own).join(topics, ["category", "topic"], "left_semi"))
    contents = written_once(parsed_documents(rows))

    def facet(frame: DataFrame, name: str, text: str) -> DataFrame:
        return frame.select(*KEYS, F.lit(name).alias("facet"), F.col(text).alias("text"))

    texts = (
        facet(O.outline_lines(contents), "outline", "text")
        .unionByName(facet(contents, "content", "main_content")).unionByName(facet(contents, "reference", "ref_block"))
    )
    asked = J.comparison_requests(texts.filter(~own), texts.filter(own), seed=seed)
    if stored is not None:
        known = stored.select(*KEYS, F.col("metric").alias("facet")).distinct()
        asked = asked.join(broadcast_if_small(written_once(known)), [*KEYS, "facet"], "left_anti")
    answers = written_once(J.judge_apply(asked.withColumnRenamed("facet", "metric"), scorer, attempts))
    fresh = J.comparison_verdicts(J.judge_parse(answers), [*KEYS, "metric"]).select(
        *KEYS, F.lit(model).alias("model"), "metric", "is_better"
    )
    return fresh if stored is None else stored.unionByName(fresh)


def compare_documents(docs: DataFrame, scorer: Callable[[str], str], **options) -> DataFrame:
    """Documents to win rates against the baseline; options as in :func:`comparison_verdicts`."""
    return M.win_rates(comparison_verdicts(docs, scorer, **options))


def document_claim_density(
    docs: DataFrame,
    scorer: Callable[[str], str],
    size: int = 300,
    attempts: int = 3,
    ledger: str | None = None,
    model: str = "default",
    **calls,
) -> DataFrame:
    """Documents to claims per sentence before and after a judge has removed repeats.

    Every section from a heading to the next is asked for its claims; claims are numbered through a document by section and
    place, and removed as in :func:`judging.claims_removed_by_judge`.  A section without an answer counts neither
    its sentences nor claims.  With ``ledger`` (a folder), answers outlive a run that fails; ``calls`` are the options
    of :func:`judging.judge_apply`.
    """
    sections = D.sections_by_heading(docs)
    sentences = D.sentence_count(F.col("section")).alias("sentences")
    asked = J.template_requests(sections, "claim_extraction", [*KEYS, "section_no", sentences])
    answers = written_once(_answers(asked, scorer, attempts, ledger, model, **calls).where("raw IS NOT NULL"))
    claims = L.claims_parse(answers, [*KEYS, "section_no"])
    kept = J.claims_removed_by_judge(
        claims, KEYS, scorer, size, ("section_no", "claim_no"),
        answers=lambda rows: _answers(rows, scorer, attempts, ledger, model, **calls),
    )
    every = docs.select(*KEYS, F.lit(0).alias("sentences"))  # documents without sections have zeros
    return L.claim_density(claims, every.unionByName(answers.select(*KEYS, "sentences")), KEYS, kept)


def similarity_items(docs: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """The texts to embed: outline paths, sections of the content, references."""
    return _items(parsed_documents(docs), outline)


def _items(contents: DataFrame, outline: DataFrame | None, wanted: str | None = None) -> DataFrame:
    """Items of all facets, or of those that the array ``wanted`` of a document names; the texts of others are not cut."""
    def of(name: str) -> DataFrame:
        return contents if wanted is None else contents.filter(F.array_contains(wanted, name)).drop(wanted)

    paths = O.outline_paths(O.outline_rows(of("outline")) if outline is None else outline)
    if wanted is not None and outline is not None:
        paths = paths.join(broadcast_if_small(of("outline").select(*KEYS).distinct()), KEYS, "left_semi")

    def facet(rows: DataFrame, name: str, number: str, text: str) -> DataFrame:
        return rows.select(
            *KEYS, F.lit(name).alias("facet"), F.col(number).cast("bigint").alias("item_no"), F.col(text).alias("text")
        )

    return (
        facet(paths, "outline", "path_no", "path")
        .unionByName(facet(D.sections_by_hash(of("content")), "content", "section_no", "section"))
        .unionByName(facet(P.reference_entries(of("reference")), "reference", "ref_pos", "entry"))
    )


def embed_apply(
    items: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 10
) -> DataFrame:
    """Add ``embedding`` to ``text`` rows, ``batch`` texts per call."""
    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in embedder(texts[at : at + batch])]
            yield frame.drop(columns="text").assign(embedding=vectors)

    kept = [f for f in items.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return items.mapInPandas(embed, schema + ", embedding array<double>")


def letter_shares(texts: list[str]) -> list[list[float]]:
    """Offline embedder: the share of each letter a to z in the text."""
    out = []
    for text in texts:
        # one pass over the bytes: those of other characters are none of a to z
        codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        counts = np.bincount(codes, minlength=123)[97:123]
        out.append((counts / max(len(text), 1)).tolist())
    return out


def document_similarity(
    docs: DataFrame,
    embedder: Callable[[list[str]], list[list[float]]] = letter_shares,
    baseline: str = BASELINE,
    metric: str = "l2sq",
    outline: DataFrame | None = None,
) -> DataFrame:
    """Mean similarity of every document to the baseline of its topic, by facet.

    ``outline`` replaces the outlines found in the texts, as after a refinement.

    Vectors are written once: both the documents and the ground truth among
    them are read from there.
    """
    vectors = written_once(embed_apply(_items(written_once(parsed_documents(docs)), outline), embedder))
    best = S.knn_query(
        vectors, vectors.filter(F.col("system") == baseline), 1,
        ("category", "topic", "facet"), ("system", "item_no"), metric,
    )
    return S.topn_mean_similarity(best, KEYS, docs=docs)


def refreshed_similarity(
    docs: DataFrame,
    stored: DataFrame,
    embedder: Callable[[list[str]], list[list[float]]] = letter_shares,
    baseline: str = BASELINE,
    metric: str = "l2sq",
    outline: DataFrame | None = None,
) -> DataFrame:
    """(keys, facet, mean_score) of ``docs``: the ``stored`` ones, and stale facets computed again.

    A facet is stale when its stored mean is 0 or null, or when it is not stored.  Only documents with a stale facet and the
    baselines of their topics are parsed, and only items of stale facets, and the baseline's items on those topics and
    facets, reach the embedder.  Stored rows of other documents are left out.
    """
    facet = [*KEYS, "facet"]
    every = docs.select(*KEYS).distinct().withColumn("facet", F.explode(F.array(*[F.lit(f) for f in FACETS])))
    known = stored.groupBy(*facet).agg(F.max("mean_score").alias("mean_score"))
    state = written_once(every.join(known, facet, "left"))
    fresh = ~F.coalesce(F.col("mean_score") != 0, F.lit(False))
    work = written_once(state.where(fresh).select(*facet))
    own = F.col("system") == baseline
    # a document carries the names of the facets to embed, so items need not be looked up again; a baseline
    # whose own facet is not stale is still compared with
    def wanted(by: list[str], rows: DataFrame) -> DataFrame:
        return broadcast_if_small(rows.groupBy(*by).agg(F.collect_set("facet").alias("wanted")))

    others = docs.filter(~own).join(wanted(KEYS, work.filter(~own)), KEYS)
    truth = docs.filter(own).join(wanted(["category", "topic"], work), ["category", "topic"])
    rows = others.unionByName(truth.select(*others.columns))
    vectors = written_once(embed_apply(_items(written_once(parsed_documents(rows, ["wanted"])), outline, "wanted"), embedder))
    asked = vectors.filter(~own).unionByName(vectors.filter(own).join(broadcast_if_small(work.filter(own)), facet, "left_semi"))
    best = S.knn_query(asked, vectors.filter(own), 1, ("category", "topic", "facet"), ("system", "item_no"), metric)
    means = S.topn_mean_similarity(best, KEYS).select(*facet, F.col("mean_score").alias("found"))
    return state.join(means, facet, "left").select(
        *facet, F.when(fresh, F.coalesce("found", F.lit(0.0))).otherwise(F.col("mean_score")).alias("mean_score")
    )


def adjusted_leaderboard(
    docs: DataFrame,
    scores: DataFrame,
    stored: DataFrame,
    embedder: Callable[[list[str]], list[list[float]]] = letter_shares,
    baseline: str = BASELINE,
    **options,
) -> DataFrame:
    """Documents, their scores and stored similarities to the leaderboard in one call.

    Stale facets are computed again (:func:`refreshed_similarity`), scores are blended with the similarities and laid out
    as plain, balanced and perfect rows.  A document whose baseline has no scores of its model is not on the board.
    """
    similar = written_once(refreshed_similarity(docs, stored, embedder, baseline, **options))
    return R.leaderboard(M.sim_adjust(scores, similar, baseline), baseline)


def finished_scores(
    docs: DataFrame,
    scorer: Callable[[str], str] = J.answer_by_digest,
    model: str = "default",
    done: DataFrame | None = None,
    attempts: int = 3,
) -> dict[str, DataFrame]:
    """Documents to the final tables: evaluated, what a judge failed asked again, averaged by files, categories and overall.

    ``scores``, ``by_files`` (R1), ``table`` (zero-filled averages laid out).
    """
    scores = written_once(evaluate_documents(docs, scorer, model, done, attempts))
    scores = written_once(supplement_scores(docs, scores, scorer, model, attempts))
    return {"scores": scores, "by_files": R.avg_by_files(scores), "table": R.score_all(scores)}
