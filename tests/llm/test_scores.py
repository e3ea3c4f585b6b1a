"""Fingerprints, quality and the pipeline against plain loops."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from helpers import documents, duck, empty, prose, rows
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgauge.llm import bpe, host_rules, mixing, order_minhash, quality
from corpusgauge.session import written_once

SF = "/root/testdata/sf0.001"


def brute_prints(spark, texts):
    """The tuples of each text by plain loops, with Spark's hash function."""
    cut = lambda t: [w[i : i + 32] for w in re.findall(r"[^\x20\x09-\x0D]+", t) for i in range(0, len(w), 32)]
    grams = {}
    for t in texts:
        w = cut(t)
        grams[t] = [tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))] if w else []
    two = spark.createDataFrame(sorted({(*g, None)[:2] for v in grams.values() for g in v}, key=repr), "a string, b string")
    base = {tuple(x for x in (r["a"], r["b"]) if x is not None): r["h"] for r in two.select("*", F.xxhash64("a", "b").alias("h")).collect()}
    numbered = sorted({(base[g], n) for v in grams.values() for g, c in Counter(v).items() for n in range(1, c)})
    frame = spark.createDataFrame(numbered or [(0, 1)], "h long, n int")
    later = {(r["h"], r["n"]): r["v"] for r in frame.select("*", F.xxhash64("h", "n").alias("v")).collect()}
    value = lambda g, n: (base[g] if n == 0 else later[base[g], n]) % 2**64
    tuples = {t: brute.fingerprint(t, 2, value, lambda v, w: (v, w), lambda v: (v,)) for t in texts}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    pairs = sorted({tuple(map(signed, v)) for f in tuples.values() for v in f.values()})
    hashed = {}
    for size in (1, 2):
        some = [p for p in pairs if len(p) == size]
        if some:
            df = spark.createDataFrame(some, ", ".join(f"c{i} long" for i in range(size)))
            hashed |= {tuple(r)[:-1]: r["h"] for r in df.select("*", F.xxhash64(*df.columns).alias("h")).collect()}
    return {t: {s << 58 | (hashed[tuple(map(signed, v))] % 2**64) >> 6 for s, v in f.items()} for t, f in tuples.items()}


def alike(a, b):
    return len(a & b) / 64 if a or b else 1.0


def test_fingerprints_of_short_texts_by_hand(spark):
    texts = ["a b a b a b c d a b", "a", "a b", "a b c", "x x x x x x x", "x" * 100, " ", prose(30, 1), prose(150, 2), prose(700, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = order_minhash.fingerprints(df, ["doc_id"], f="text").collect()
    want = brute_prints(spark, texts)
    for r in got:
        assert sorted(x % 2**64 for x in r["f"]) == sorted(want[texts[r["doc_id"]]])


def test_neighbours_by_brute_force(spark):
    long = prose(40, 5)
    texts = [
        "", " ", "a", "ab", "a b", "a b c", "one two three four", "onetwothreefour" * 9, " lead and trail  ", long, long[:-3] + " ", long,
        "\t\n" * 9 + "word", "é 漢字 " * 30, "x " * 200, prose(300, 6), prose(300, 7), "word" * 3 + " " * 4, None, "tail",
    ]
    plain = [t or "" for t in texts]
    want, others = [], []
    for t, after in zip(plain, plain[1:] + plain[:1], strict=True):
        cut = len(t) // 4
        others.append(t[: len(t) - cut] + after[:cut])
    prints = brute_prints(spark, sorted({*plain, *others}))
    shown = lambda f: "-".join(f"{x:x}" for x in sorted(f, key=lambda x: (x + 2**63) % 2**64))
    for i, (t, e) in enumerate(zip(plain, others, strict=True)):
        after = plain[(i + 1) % len(plain)]
        want.append((i, shown(prints[t]), shown(prints[e]), alike(prints[t], prints[e]), alike(prints[t], prints[after])))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    got = order_minhash.neighbours(df).collect()
    assert sorted((r["doc_id"], r["fingerprint"].lower(), r["edited_fingerprint"].lower(), r["near_edited"], r["near_next"]) for r in got) == want


@pytest.mark.parametrize("n", [20, 40, 60, 100, 400])
def test_swapped_halves_are_half_alike(spark, n):
    rows_ = []
    for i in range(30):
        words = [f"w{i}x{j}" for j in range(n)]
        rows_.append((i, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    df = order_minhash.fingerprints(spark.createDataFrame(rows_, "doc_id long, a string, b string"), ["doc_id"], a="a", b="b")
    got = df.select(F.avg(order_minhash.likeness(F.col("a"), F.col("b")))).first()[0]
    assert 0.35 < got < 0.58


@pytest.mark.parametrize("per_range", [5, 2_000])
def test_neighbours(spark, per_range, monkeypatch):
    monkeypatch.setattr(order_minhash, "ROWS_PER_RANGE", per_range)
    found = sorted(((i, t or "") for i, t, _ in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = order_minhash.neighbours(documents(spark)).collect()
    prints = {}
    want = []
    for (i, text), (_, after) in zip(found, found[1:] + found[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    texts = {}
    for i, t in found:
        texts.setdefault(i, set()).add(t)
    for r in got:
        if len(texts[r["doc_id"]]) == 1:
            (text,) = texts[r["doc_id"]]
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long_ones = [r for r in got if r["n_chars"] > 1000]
    assert sum(r["near_edited"] for r in long_ones) / len(long_ones) > 0.25
    assert all(r["near_next"] == 1 for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 111)  # copies side by side


def test_order_matters_and_empty_tables_are_empty(spark):
    words = prose(400, 3).split()
    halves = " ".join(words[200:] + words[:200])
    shuffled = list(words)
    random.Random(2).shuffle(shuffled)
    texts = [(1, " ".join(words)), (2, halves), (3, " ".join(shuffled)), (4, " ".join(words))]
    df = order_minhash.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"], f="text")
    prints = {r["doc_id"]: set(r["f"]) for r in df.collect()}
    same = lambda a, b: len(prints[a] & prints[b]) / 64
    assert prints[1] == prints[4] and same(1, 2) < 0.8 and same(1, 3) < 0.1
    assert order_minhash.neighbours(empty(spark)).collect() == []
    only = order_minhash.neighbours(documents(spark, [(1, "a b c d", "s")])).first()
    assert only["near_next"] == 1.0


def labelled(spark, n=160):
    rng, found, labels = random.Random(3), [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(80, i)
        found.append((i, text if good else " ".join(w + "***" for w in text.split()), f"h{i % 7}"))
        if i % 4:
            labels.append((i, int(good), 0))
    return found, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: "*" not in t for i, t, _ in found}


def test_quality_on_held_out_documents(spark):
    found, labels, truth = labelled(spark)
    rows_ = written_once(quality.measured(documents(spark, found), "source", "lang"))
    got = quality.scored(rows_, quality.fitted(rows_, labels)).collect()
    assert len(got) == len(found)
    assert np.mean([r["kept"] == truth[r["doc_id"]] for r in got if r["doc_id"] % 4 == 0]) > 0.95


def test_the_fit_takes_the_smallest_hashed_ids(spark):
    found, labels, _ = labelled(spark)
    rows_ = written_once(quality.measured(documents(spark, found), "source", "lang"))
    order = rows_.join(labels, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).select(*quality.FEATURES, "quality").toPandas()
    want = quality.fit(order[quality.FEATURES].to_numpy(float), order["quality"].to_numpy(float))
    assert quality.fitted(rows_, labels, most=20) == want


def test_posteriors_by_hand(spark):
    odds = {1: 2.0, 2: -1.0, 3: 0.5, 4: 3.0, 5: -2.0, 6: 1.0, 7: 2.5}
    where = {1: ("a", "x"), 2: ("a", "x"), 3: ("a", "y"), 4: ("b", "x"), 5: ("b", "x"), 6: ("b", "z"), 7: (None, None)}
    flat = dict.fromkeys(quality.FEATURES, 0.0)
    rows_ = spark.createDataFrame(
        [(i, str(where[i][0]), str(where[i][1]), odds[i], *[0.0] * (len(flat) - 1)) for i in odds],
        "doc_id long, host string, path string, " + ", ".join(f"{n} double" for n in quality.FEATURES),
    )
    model = quality.Model((0.0,) * 9, (1.0,) * 9, (1.0, *[0.0] * 8), 0.0, 0.4)
    got = {r["doc_id"]: r for r in quality.scored(rows_, model).collect()}
    p = {i: round(1e6 / (1 + math.exp(-o))) / 1e6 for i, o in odds.items()}
    mean = sum(p.values()) / 7

    def weight(groups, means):
        n = sum(len(g) for g in groups)
        between = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means, strict=True))
        beyond = (between - sum(m * (1 - m) for m in means)) / n
        spread = sum(len(g) * m * (1 - m) for g, m in zip(groups, means, strict=True)) / n
        return n if beyond <= 0 or spread / beyond > n else round(max(1.0, spread / beyond - 1), 6)

    by_host = {h: [p[i] for i in odds if where[i][0] == h] for h in ("a", "b", None)}
    m = weight(list(by_host.values()), [mean] * 3)
    host = {h: (sum(g) + mean * m) / (len(g) + m) for h, g in by_host.items()}
    by_path = {w: [p[i] for i in odds if where[i] == w] for w in set(where.values())}
    below = weight(list(by_path.values()), [host[w[0]] for w in by_path])
    for i, r in got.items():
        h, g = host[where[i][0]], by_path[where[i]]
        assert r["host_posterior"] == pytest.approx(h, abs=1e-6)
        assert r["path_posterior"] == pytest.approx((sum(g) + h * below) / (len(g) + below), abs=1e-6)
        prior = (sum(g) - p[i] + h * below) / (len(g) - 1 + below)
        score = 1 / (1 + math.exp(-(odds[i] - 0.4 + math.log(prior / (1 - prior)))))
        assert r["score"] == pytest.approx(score, abs=2e-6) and r["kept"] == (r["score"] >= 0.5)


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows_ = written_once(quality.measured(documents(spark), "source", "lang"))
    assert quality.scored(rows_, quality.fitted(rows_, none)).count() == len(rows())
    odd = spark.createDataFrame([(1, None, 0), (2, 5, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored(rows_, quality.fitted(rows_, odd)).count() == len(rows())
    nothing = written_once(quality.measured(empty(spark), "source", "lang"))
    assert quality.scored(nothing, quality.fitted(nothing, none)).collect() == []


def stepwise(found):
    """Rows that the first three stages leave, by SQL and loops."""
    ruled = duck(host_rules.host_rules_sql(), found)
    # columns by name: base_failed, doc_id, kept, ...
    kept = {r[1] for r in ruled if r[2]}
    found = [r for r in found if r[0] in kept]
    k, percent = corpus_pipeline.NEAR_K, corpus_pipeline.NEAR_PERCENT
    groups = brute.components([r[:2] for r in found], percent, k)
    found = [r for r in found if (r[0], len(brute.shingles(r[1], k)), r[0]) in groups]
    seen, out = {}, []
    data = {i: (t or "").encode() for i, t, _ in found}
    for i in sorted(data):
        for j in range(len(data[i]) - 49):
            seen.setdefault(data[i][j : j + 50], i)
    for i, text, source in found:
        gone = bytearray(len(data[i]))
        for j in range(len(gone) - 49):
            if seen[data[i][j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        cut = bytes(b for b, g in zip(data[i], gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((i, cut if any(gone) else text, source))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = stepwise([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    mixed = duck(mixing.mixing_sql(), left)  # doc_id, size, source_size, taken, target
    texts = {i: t or "" for i, t, _ in left}
    want = []
    for i, size, _, taken, _ in mixed:
        ids = bpe.tokenizer(bpe.default_vocabulary()).encode(texts[i], add_special_tokens=False).ids
        want += [(i, len(ids), tuple(ids), hashlib.sha256(texts[i].encode()).hexdigest())] * (taken // size if size else 0)
    got = [(r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    sized = {i for i, size, *_ in mixed if size}
    assert sorted(x for x in got if x[0] in sized) == sorted(want) and len(want) > 50


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written_once(stage(spark, docs, ""))
        assert out.columns == docs.columns
        docs = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").collect() == []


def near_copies():
    """(doc_id, text, source): copies with a block of words replaced and with words changed here and there, and others."""
    base = prose(600, 4000).split(" ")
    block = base[:200] + [f"b{i}" for i in range(len(base) // 12)] + base[200 + len(base) // 12 :]
    spots = [f"r{i}" if i % 52 == 7 else w for i, w in enumerate(base)]
    half = base[: len(base) // 2] + [f"h{i}" for i in range(len(base) // 2)]
    texts = [base, block, spots, half, prose(600, 4001).split(" ")]
    return [(i, " ".join(t), "s") for i, t in enumerate(texts)]


def test_near_copies_by_five_words_go(spark):
    found = near_copies()
    assert [i for i, _, c in brute.components([r[:2] for r in found]) if i == c] == [0, 1, 2, 3, 4]  # by three words and 90 per cent all stay
    out = corpus_pipeline.keep_one_of_each(spark, documents(spark, found), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 3, 4]
