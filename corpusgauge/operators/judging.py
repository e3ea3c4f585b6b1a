r"""Judging as data: requests out, responses in, scores merged.

The scoring model itself is a function the caller passes to ``judge_apply``;
everything around it is DataFrame work.  Rubrics and prompt templates are
data as well: pass your own in place of the defaults.
"""

from __future__ import annotations

import hashlib
import json
import queue
import re
import string
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.json import list_items, object_fields
from corpusgauge.operators.claims import listed_places
from corpusgauge.operators.metrics import pairwise_assign, pairwise_unswap
from corpusgauge.schema import CONTENT_CRITERIA, DOC_KEYS, FACET_METRICS
from corpusgauge.session import written_once

# Default rubric: criterion, facet, question, meaning of the grades 1 to 5.
DEFAULT_RUBRIC = [
    ("Coverage", "content", "Does the text treat every part of its subject?",
     "a small corner only", "several gaps", "most parts", "nearly all parts", "all parts in depth"),
    ("Structure", "content", "Do the sections follow from one another?",
     "no order", "weak order", "mostly ordered", "well ordered", "seamless order"),
    ("Relevance", "content", "Does the text stay on its subject?",
     "off the subject", "often strays", "sometimes strays", "rarely strays", "never strays"),
    ("Language", "content", "Is the writing formal, clear and correct?",
     "full of errors", "many errors", "some errors", "few errors", "flawless"),
    ("Criticalness", "content", "Does the text weigh its sources and point ahead?",
     "no judgement", "little judgement", "some judgement", "good judgement", "original judgement"),
    ("Outline", "outline", "Is the list of headings clear and well grouped?",
     "confusing", "loosely grouped", "mostly clear", "clear", "clear and complete"),
    ("Reference", "reference", "Do the references belong to the subject, in one format?",
     "most do not", "about half do", "most do", "nearly all do", "all do"),
]

# Default templates; fields in braces are filled from columns of that name.
TEMPLATES = {
    "criterion": 'Subject: "{topic}"\n---\n{text}\n---\nCriterion: {question}\n1: {s1}\n2: {s2}\n3: {s3}\n4: {s4}\n5: {s5}\nAnswer as JSON {{"{criterion}": <1-5>}}.',
    "all_criteria": 'Subject: "{topic}"\n---\n{text}\n---\nGrade each criterion from 1 to 5:\n{rubric}\nAnswer as one JSON object, criterion to grade.',
    "children": 'Subject: "{topic}"\nHeading {parent_pos}: {parent_title}\nChildren:\n{children_list}\nFor each child say Yes or No: is it a needed, direct part of the heading? Answer as JSON {{"children": [{{"child_index": <n>, "is_included": "Yes"}}]}}.',
    "faithfulness": 'Subject: "{topic}"\nSentence: {sentence}\nReferences:\n{references}\nCount the citations in the sentence and how many of them a listed reference supports. Answer as JSON {{"total": <n>, "supported": <n>}}.',
    "reference_batch": 'Subject: "{topic}"\nReferences:\n{batch}\nCount the references and how many strongly support the subject. Answer as JSON {{"total": <n>, "supported": <n>}}.',
    "comparison": 'Subject: "{topic}"\nFirst {facet}:\n{position_1}\nSecond {facet}:\n{position_2}\nIs the first better? Answer as JSON {{"is_better": true or false, "reason": "..."}}.',
    "claim_extraction": "Text:\n{section}\nList its checkable statements as numbered lines, each complete in itself.",
    "claim_removal": "Claims:\n{numbered}\nList the numbers of claims that repeat another one, separated by commas.",
    "outline_refine": "Headings, all of level 1:\n[\n{text}\n]\nDrop lines that are no headings and set better levels. Answer as a JSON list of [level, title].",
}


def fill(template: str, **columns: Column) -> Column:
    """A template as one string expression; values are never re-scanned."""
    pieces = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            value = columns.get(field)
            pieces.append((F.col(field) if value is None else value).cast("string"))
    return F.concat(*pieces)


def criterion_requests(
    texts: DataFrame,
    rubric: Sequence[tuple] = DEFAULT_RUBRIC,
    template: str = TEMPLATES["criterion"],
    keys: Sequence[str] = DOC_KEYS,
) -> DataFrame:
    """One prompt per text and criterion of its facet (``facet, text`` columns).

    The rubric is a handful of literals, so it is unfolded in the row.
    """
    fields = ("criterion", "facet", "question", "s1", "s2", "s3", "s4", "s5")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, r)]) for r in rubric])
    wanted = F.filter(rows, lambda r: r["facet"] == F.col("facet"))
    return texts.select(*keys, "text", F.explode(wanted).alias("r")).select(
        *keys, F.col("r.criterion").alias("criterion"),
        fill(template, **{n: F.col(f"r.{n}") for n in fields if n != "facet"}).alias("prompt"),
    )


def all_criteria_requests(
    texts: DataFrame,
    rubric: Sequence[tuple] = DEFAULT_RUBRIC,
    criteria: Sequence[str] = CONTENT_CRITERIA,
    template: str = TEMPLATES["all_criteria"],
    keys: Sequence[str] = DOC_KEYS,
) -> DataFrame:
    """One prompt per text with the whole rubric in it."""
    listed = "\n".join(
        f"{r[0]}: {r[2]} " + "; ".join(f"{n} = {g}" for n, g in enumerate(r[3:], 1))
        for r in rubric if r[0] in criteria
    )
    return texts.select(*keys, fill(template, rubric=F.lit(listed)).alias("prompt"))


def template_requests(
    rows: DataFrame, task: str, keys: Sequence[str], template: str | None = None, **columns: Column
) -> DataFrame:
    """One prompt per row from the template of ``task``."""
    return rows.select(*keys, fill(template or TEMPLATES[task], **columns).alias("prompt"))


def comparison_requests(
    texts: DataFrame, baseline: DataFrame, template: str = TEMPLATES["comparison"], seed: int = 0
) -> DataFrame:
    """Each system's text against the baseline's of the same topic and facet.

    Which of the two comes first is a hash of the key, kept in ``swapped``.
    """
    where = ["category", "topic", "facet"]
    # baseline texts are long, so only adaptive execution repeats them, for the
    # parts of a topic it finds oversized
    pairs = texts.join(baseline.select(*where, F.col("text").alias("baseline_text")), where)
    placed = pairwise_assign(pairs, "text", "baseline_text", [*DOC_KEYS, "facet"], seed)
    return placed.select(*DOC_KEYS, "facet", "swapped", fill(template).alias("prompt"))


def claim_removal_requests(claims: DataFrame, keys: Sequence[str], size: int = 300) -> DataFrame:
    """One prompt per document and group of ``size`` claims, numbered from 1."""
    place = (F.col("claim_no") % size + 1).cast("int")
    grouped = claims.select(
        *keys, F.floor(F.col("claim_no") / size).cast("int").alias("group_no"), place.alias("place"), "claim"
    ).groupBy(*keys, "group_no").agg(F.array_sort(F.collect_list(F.struct("place", "claim"))).alias("claims"))
    line = F.transform("claims", lambda c: F.concat(c["place"].cast("string"), F.lit(". "), c["claim"]))
    return template_requests(grouped, "claim_removal", [*keys, "group_no"], numbered=F.array_join(line, "\n"))


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with as many underscores in front as make it none of ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def claims_removed_by_judge(
    claims: DataFrame,
    keys: Sequence[str],
    scorer: Callable[[str], str],
    size: int = 300,
    order: Sequence[str] = ("claim_no",),
    answers: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``claims`` without those a judge calls repeats: within groups of ``size``, then between groups, two by two.

    Claims are numbered densely in a document by ``order`` and their text.  In every round two neighbouring groups
    become one, so in the end any two claims have been in one prompt unless one of them went before.  A group that
    meets no other is not asked again; a prompt without an answer removes nothing.  Only documents that still have
    groups to meet take part in a round: a claim is written as often as its own document needs, and what is
    finished is not read again.  The numbers of repeats are written before the next round reads them, and one row a round, whether any
    document is left, comes to the driver.  The last prompt of a document holds all its remaining claims.

    ``answers`` replaces the call of ``scorer``: rows with ``prompt`` to rows with ``raw``, as from a ledger.
    """
    keys, columns = list(keys), claims.columns
    number, last = unused("_no", columns), unused("_last", columns)
    doc = Window.partitionBy(*keys)
    place = F.row_number().over(doc.orderBy(*order, "claim")) - 1
    names = {unused(f"_{i}", columns): k for i, k in enumerate(keys)}
    in_doc = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for n, k in names.items()])
    left = written_once(claims.withColumns({number: place, last: F.count("*").over(doc) - 1}))
    ask = answers or (lambda rows: judge_apply(rows, scorer))
    finished, wide = [], size
    while True:
        halves = F.count_distinct(F.floor(F.col(number) / max(wide // 2, 1)))
        met = (
            left.groupBy(*keys, F.floor(F.col(number) / wide).alias("_group"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), "claim"))).alias("_claims"), halves.alias("_halves"))
            .where(F.lit(wide == size) | (F.col("_halves") > 1))
        )
        line = F.transform("_claims", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["claim"]))
        asked = template_requests(met, "claim_removal", [*keys, F.col("_claims.n").alias("_numbers")], numbered=F.array_join(line, "\n"))
        found = ask(asked)
        numbers = F.transform(listed_places(F.col("raw")), lambda p: F.when(p > 0, F.get("_numbers", p - 1)))
        gone = found.select(*[F.col(k).alias(n) for n, k in names.items()], F.explode(numbers).alias("_gone")).where("_gone IS NOT NULL")
        kept = left.join(written_once(gone), in_doc & (F.col(number) == F.col("_gone")), "left_anti")
        # claims of finished documents are not written again: who only counts them does not move their texts
        finished.append(kept.where(F.col(last) < wide).select(*columns))
        left = written_once(kept.where(F.col(last) >= wide))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        wide *= 2


def answer_by_digest(prompt: str) -> str:
    """Offline scorer: every answer follows from the first hex digit of the
    prompt's MD5, so runs without a model are repeatable."""
    digit = int(hashlib.md5(prompt.encode("utf-8")).hexdigest()[0], 16)
    answer = {name: 1 + digit % 5 for facet in FACET_METRICS.values() for name in facet}
    children = re.findall(r"^  - Index: (\d+),", prompt, re.MULTILINE)
    answer["children"] = [
        {"child_index": c, "is_included": "No" if (int(c) + digit) % 3 == 0 else "Yes"} for c in children
    ]
    return json.dumps({**answer, "score": 1 + digit % 5, "total": 1 + digit, "supported": digit})


def _answered(scorer, prompt, attempts: int, delay: float, timeout: float | None):
    """The scorer's answer, or None after ``attempts``; pauses double.  A call beyond ``timeout`` is left behind in its thread."""
    for attempt in range(attempts):
        try:
            if timeout is None:
                return scorer(prompt)
            return _in_thread(scorer, prompt).result(timeout)
        except Exception:  # noqa: BLE001 - any failure of the service is retried
            if delay and attempt + 1 < attempts:
                time.sleep(delay * 2**attempt)
    return None


def _in_thread(call, *args) -> Future:
    """The result of a call in a thread of its own, which ends with the process even if the call hangs."""
    found = Future()
    threading.Thread(target=_settle, args=(found, call, *args), daemon=True).start()
    return found


def _settle(found: Future, call, *args) -> None:
    try:
        found.set_result(call(*args))
    except BaseException as failure:  # noqa: BLE001 - raised where the result is read
        found.set_exception(failure)


def _serve(waiting: queue.SimpleQueue, call) -> None:
    """Settles what waits, one after the other, up to a None: a thread for each prompt would cost more than a short call."""
    while (item := waiting.get()) is not None:
        found, prompt = item
        _settle(found, call, prompt)


def judge_apply(
    requests: DataFrame,
    scorer: Callable[[str], str] = answer_by_digest,
    attempts: int = 3,
    delay: float = 0.0,
    timeout: float | None = None,
    calls: int = 1,
) -> DataFrame:
    """Add ``raw``: the scorer's answer to each ``prompt``.

    A prompt that fails ``attempts`` times, or takes longer than ``timeout`` seconds each time, gets a null; pauses
    between attempts begin with ``delay`` seconds and double.  Every task has up to ``calls`` prompts with the
    scorer at once, which must then stand being called from several threads.  Rows stream through
    in Arrow batches and keep their order; nothing is held beyond one batch, and a lost task only
    repeats its own prompts.
    """

    def ask(prompt):
        return _answered(scorer, prompt, attempts, delay, timeout)

    def raws(prompts) -> Iterator:
        if calls == 1:
            yield from map(ask, prompts)
            return
        window, waiting = deque(), queue.SimpleQueue()
        for _ in range(calls):
            threading.Thread(target=_serve, args=(waiting, ask), daemon=True).start()
        try:
            for prompt in prompts:
                if len(window) == calls:
                    yield window.popleft().result()
                window.append(Future())
                waiting.put((window[-1], prompt))
            while window:
                yield window.popleft().result()
        finally:
            for _ in range(calls):
                waiting.put(None)

    def answer(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.schema.get_field_index("prompt")
            # long prompts leave the batch one by one, so no second copy of them all is made
            found = pa.array(raws(p.as_py() for p in batch.column(at)), pa.string())
            rest = [c for n, c in enumerate(batch.columns) if n != at]
            names = [name for n, name in enumerate(batch.schema.names) if n != at]
            yield pa.RecordBatch.from_arrays([*rest, found], names=[*names, "raw"])
            del batch, rest
            pa.default_memory_pool().release_unused()

    kept = [f for f in requests.schema.fields if f.name != "prompt"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", raw string"
    return requests.mapInArrow(answer, schema)


def judge_parse(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``fields`` (map, empty when nothing parses) and ``parsed``."""
    fields = object_fields(F.col(raw))
    empty = F.create_map().cast("map<string,string>")
    return responses.withColumn("fields", fields).withColumns(
        {"parsed": F.col("fields").isNotNull(), "fields": F.coalesce("fields", empty)}
    )


def judge_parse_list(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per list item; a response that holds no list gives no rows."""
    keep = [c for c in responses.columns if c != raw]
    return responses.select(*keep, F.posexplode(list_items(F.col(raw))).alias("item_no", "item"))


def judge_scores(parsed: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Requested criteria as rows; a missing or malformed grade is 0."""
    keep = [c for c in parsed.columns if c not in ("fields", "parsed", "raw")]
    cells = [
        F.struct(
            F.lit(c).alias("metric"),
            F.coalesce(F.try_element_at("fields", F.lit(c)).try_cast("double"), F.lit(0.0)).alias("value"),
        )
        for c in criteria
    ]
    return parsed.select(*keep, F.inline(F.array(*cells)))


def children_verdicts(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per child of the answer, judged or not; a parent without any keeps one with a null ``child``."""
    listed = F.from_json(
        F.try_element_at("fields", F.lit("children")), "array<struct<child_index:string,is_included:string>>"
    )
    return parsed.select(*keys, F.posexplode_outer(listed).alias("child", "c")).select(
        *keys, "child", "c.child_index", "c.is_included"
    )


def support_verdicts(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``total`` and ``supported`` counts of an answer, 0 when it has none."""
    def count(name: str) -> Column:
        number = F.try_element_at("fields", F.lit(name)).try_cast("double").cast("bigint")
        return F.coalesce(number, F.lit(0)).alias(name)

    return parsed.select(*keys, count("total"), count("supported"))


def comparison_verdicts(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the system won, from answers about swapped positions.

    Answers without a verdict give no rows.
    """
    better = F.try_element_at("fields", F.lit("is_better")).try_cast("boolean")
    rows = parsed.select(
        *keys, "swapped", better.alias("is_better"),
        F.coalesce(F.try_element_at("fields", F.lit("reason")), F.lit("")).alias("reason"),
    )
    return pairwise_unswap(rows.filter(F.col("is_better").isNotNull())).drop("swapped")


def pending_work(
    expected: DataFrame,
    scores: DataFrame,
    facets: Mapping[str, Sequence[str]] = FACET_METRICS,
    keys: Sequence[str] = (*DOC_KEYS, "model"),
) -> DataFrame:
    """Facets of expected documents with any of their metrics absent.

    Expected documents and scores meet in one aggregation with partial
    counts, so this is a single exchange however the scores are spread.
    """
    keys = list(keys)
    wanted = [m for names in facets.values() for m in names]
    both = (
        expected.select(*keys, F.lit(True).alias("wanted"), F.lit(None).cast("string").alias("metric"))
        .unionByName(
            scores.filter(F.col("metric").isin(wanted)).select(*keys, F.lit(None).cast("boolean").alias("wanted"), "metric")
        )
    )
    has = {m: F.max(F.col("metric") == m) for m in wanted}
    known = both.groupBy(*keys).agg(
        F.max("wanted").alias("wanted"), *[F.coalesce(c, F.lit(False)).alias(m) for m, c in has.items()]
    )
    lacking = [
        F.when(~_all(F.col(m) for m in names), F.lit(facet)) for facet, names in facets.items()
    ]
    return known.filter("wanted").select(
        *keys, F.explode(F.filter(F.array(*lacking), lambda f: f.isNotNull())).alias("facet")
    )


def _all(flags) -> Column:
    out = F.lit(True)
    for flag in flags:
        out = out & flag
    return out


def missing_scores(scores: DataFrame, keys: Sequence[str] = (*DOC_KEYS, "model")) -> DataFrame:
    """What to score again: ``Content`` when any content metric is zero or
    absent, another metric when it is present and zero."""
    single = ["Outline", "Reference", "Outline_structure", "Reference_quality"]
    metric, value = F.col("metric"), F.col("value")
    known = scores.groupBy(*keys).agg(
        F.count_if(metric.isin(CONTENT_CRITERIA) & (value != 0)).alias("content"),
        *[F.count_if((metric == m) & (value == 0)).alias(m) for m in single],
    )
    work = F.array(
        F.when(F.col("content") < len(CONTENT_CRITERIA), F.lit("Content")),
        *[F.when(F.col(m) > 0, F.lit(m)) for m in single],
    )
    return known.select(*keys, F.explode(F.filter(work, lambda w: w.isNotNull())).alias("work"))


def merge_scores(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = (*DOC_KEYS, "model", "metric"),
    zeros_only: bool = False,
) -> DataFrame:
    """New scores over old ones; with ``zeros_only`` just where the old is 0.

    Both sides are keyed by score, so a union and one aggregation do it.
    """
    both = old.select(*keys, F.col("value").alias("old"), F.lit(None).cast("double").alias("new")).unionByName(
        new.select(*keys, F.lit(None).cast("double").alias("old"), F.col("value").alias("new"))
    )
    merged = both.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    value = F.coalesce("new", "old")
    if zeros_only:
        value = F.when(F.col("old") != 0, F.col("old")).otherwise(value)
    return merged.select(*keys, value.alias("value"))


def clear_scores(
    scores: DataFrame,
    category: str | None = None,
    system: str | None = None,
    model: str | None = None,
    metrics: Sequence[str] | str | None = None,
) -> DataFrame:
    """Drop scores that match every part given; no part means all scores."""
    doomed = F.lit(True)
    for name, value in (("category", category), ("system", system), ("model", model)):
        if value is not None:
            doomed = doomed & F.col(name).eqNullSafe(value)
    if metrics is not None:
        doomed = doomed & F.col("metric").isin([metrics] if isinstance(metrics, str) else list(metrics))
    return scores.filter(~doomed)


def drop_systems(rows: DataFrame, systems: Sequence[str]) -> DataFrame:
    return rows.filter(~F.col("system").isin(list(systems)))
