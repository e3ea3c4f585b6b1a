"""Near copies and repeated passages against plain loops."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, empty, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgauge.llm import jaccard, shingles, suffixes
from corpusgauge.llm.graph import components

TEXTS = [(i, t) for i, t, _ in rows()]


def families():
    """Sources with many changed copies, so that families hold linked and unlinked members."""
    rng, out = random.Random(4), []
    for f in range(2):
        source = prose(260, 500 + f).split()
        for i in range(30):
            words = list(source)
            for _ in range(rng.randrange(0, 12)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            out.append((3000 + 100 * f + i, " ".join(words[: rng.choice((260, 260, 250))])))
    return out


def frame(spark, found):
    return documents(spark, [(i, t, "s") for i, t in found])


@pytest.mark.parametrize("chunk", [5, 2_000])
def test_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard.family_links, "__defaults__", (chunk,))
    found = TEXTS + families()
    assert Counter(tuple(r) for r in jaccard.linked(frame(spark, found)).collect()) == brute.components(found)


def test_without_families_the_index_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_VOTES", 99)
    found = families()
    assert Counter(tuple(r) for r in jaccard.linked(frame(spark, found)).collect()) == brute.components(found)


def test_parities_bound_the_difference_of_large_and_small_sets(spark):
    rng = np.random.default_rng(8)
    sets, pairs = [], []
    for n in (3, 600, 1023, 1025, 2048, 2049, 5000):
        x = rng.integers(0, 2**64, n, np.uint64)
        for drop in (0, n // 40, n // 15, n // 8):
            y = np.concatenate((x[: n - drop], rng.integers(0, 2**64, drop // 2, np.uint64)))
            other = rng.integers(0, 2**64, n, np.uint64)
            i = len(sets)
            sets += [x, y, other]
            pairs += [(i, n, i + 1, len(y)), (i + 1, len(y), i, n), (i, n, i + 2, n)]
    table = spark.createDataFrame([(i, jaccard.parities(s).tolist()) for i, s in enumerate(sets)], "set_id long, parity array<long>")
    kept = {tuple(r) for r in jaccard.unlike_parities(spark.createDataFrame(pairs, "a long, an long, b long, bn long"), table, 90).collect()}
    for a, an, b, bn in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 90 * (an + bn - both):
            assert (a, b) in kept
        elif both == 0 and an > 500:
            assert (a, b) not in kept


def test_one_of_each(spark):
    found = [r for r in TEXTS if r[0] not in (5, 6)] + [(5, TEXTS[0][1])] * 2
    docs = frame(spark, found)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    want = {d for d, n, c in brute.components(found) if d is None or d == c}
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_no_documents(spark):
    for fn in (jaccard.linked, jaccard.one_of_each, suffixes.without_repeats, suffixes.deduplicated):
        assert fn(empty(spark)).collect() == []


def test_labels_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 500 + i) for i in range(50)] + [(3, 3), (9, 8), (8, 9)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {500 + i: 7 for i in range(50)} | {9: 8, 8: 8}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\t\n\x0b\x0c\r\x00", max_size=20), min_size=1, max_size=6))
def test_shingle_sets_are_sets_of_words(texts):
    got = [s.tolist() for s in shingles.shingle_sets(pa.array(texts, pa.string()), 3)]
    want = [brute.shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(want[i] & want[j])


def cut(spark, found):
    rows_ = suffixes.without_repeats(frame(spark, found)).select(
        F.col("_row.doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)
    )
    return Counter(tuple(r) for r in rows_.collect())


def passages():
    rng, shared, out = random.Random(6), prose(40, 700), []
    noise = lambda n: "".join(rng.choice("abcd éfg") for _ in range(n))
    for i in range(30):
        a, b = rng.randrange(0, 30), rng.randrange(60, 160)
        out.append((5000 + i, noise(60) + shared[a:b] + noise(60)))
    out += [(5100, "a" * 300), (5101, "b" + "a" * 200 + "c"), (5102, "xé" * 30 + "é" * 40), (5103, "é" * 60), (5104, "ab" * 100)]
    return [*out, (None, shared * 2), (None, shared), (5104, "ab" * 40 + "ba" * 40), (5105, "a" * 49)]


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeated_passages(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    found = [r for r in TEXTS if r[0] != 208] + passages()
    assert cut(spark, found) == brute.removals(found)


def test_small_merges_and_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MERGE_BYTES", 300)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 100)
    monkeypatch.setattr(suffixes, "EMIT_PIECES", 20)
    found = passages() + families()[:12]
    assert cut(spark, found) == brute.removals(found)


def test_texts_lose_their_repeats(spark):
    found = [(1, "x" * 10 + prose(30, 1)), (2, prose(30, 1)), (3, None), (4, "é" * 50 + "q"), (5, "é" * 26 + "r"), (6, "ü" + "é" * 30)]
    docs = frame(spark, found)
    out = suffixes.deduplicated(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[1][0] == found[0][1] and got[2] == ("", 0) and got[3] == (None, None)
    assert got[5] == ("r", 1) and got[6] == ("ü", 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=1, max_size=12), min_size=1, max_size=5), min_size=1, max_size=4))
def test_merged_transforms_are_the_sorted_suffixes(shards):
    depth, parts = 6, []
    for strings in shards:
        text = np.frombuffer(b"".join(s.encode() + b"\xff" for s in strings), np.uint8)
        parts.append((text, *suffixes.transform(text)))
    order, common = suffixes.merged([p[2] for p in parts], [p[3] for p in parts], depth)
    rows_, number = [], 0
    for text, suffix, _, _ in parts:
        whole = text.tobytes()
        for s in suffix.tolist():
            end = whole.index(b"\xff", s)
            ends = whole.count(b"\xff", 0, end)
            rows_.append([*whole[s:end], 1000 + number + ends][:depth])  # ends differ from one another
        number += int((text == 255).sum())
    got = [rows_[i] for i in order.tolist()]
    assert got == sorted(rows_)
    for i in range(1, len(got)):
        same = next((j for j, (x, y) in enumerate(zip(got[i - 1], got[i], strict=False)) if x != y), -1)
        assert common[i] == same


def test_families_meet_by_their_pivots_once(spark):
    a, b = range(100, 130), range(200, 230)  # every set of either family has the tokens 1 to 5; 300 is a set alone
    entries = [(t, s, 200, t) for s in [*a, *b, 300] for t in range(1, 6)]
    table = spark.createDataFrame(entries, "token long, set_id long, n int, p int")
    members = spark.createDataFrame([(s, f[0]) for f in (a, b) for s in f[1:]], "set_id long, pivot long")
    labels = spark.createDataFrame([(s, f[0]) for f in (a, b) for s in f], "node long, label long")
    found = jaccard.family_pairs(table, members, labels, 80)
    assert sorted(map(tuple, found.collect())) == [(100, 200), (100, 300), (200, 300)]


def test_a_large_family_is_there_once_for_all_that_are_near_it(spark):
    large, single = range(901, 951), range(1, 21)
    families = [(900, s, 100, s % 4) for s in large] + [(s, s, 100, 0) for s in single] + [(30, 30, 60, 0)]
    table = spark.createDataFrame(families, "family long, set_id long, n long, unlike long")
    pivots = spark.createDataFrame([(s, 900, 13 + s % 2) for s in single] + [(30, 900, 80)], "a long, b long, unlike long")
    found = sorted(map(tuple, jaccard.joint_families(pivots, table, 90).collect()))
    assert found == sorted((900, s) for s in [*(x for x in large if x % 4 == 3), *(x for x in single if x % 2 == 0)])


def test_members_of_two_families_link_where_their_pivots_do_not(spark):
    words = [f"w{i}" for i in range(400)]

    def text(first, last):
        return " ".join(f"x{i}" if i < first else f"y{i}" if i >= last else words[i] for i in range(400))

    rows = [(10 * n + i, text(a + 3 * i, b - 2 * i)) for n, (a, b) in enumerate([(0, 400), (28, 372), (0, 380), (60, 400)]) for i in range(6)]
    for percent in (80, 85):
        found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, rows), 5, percent).collect())
        assert found == brute.components(rows, percent, 5)


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from corpusgauge import session

    name, seen = session.BATCH_SETTING, {}
    monkeypatch.setattr(session, "BATCH_BYTES", 30_000)

    def noted(module, fn):
        keep = getattr(module, fn)

        def note(df, *rest):
            sizes = df.sparkSession.range(400).selectExpr("repeat('x', 1000) AS t").coalesce(1).mapInArrow(
                lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long"
            )
            seen[fn] = max(r.n for r in sizes.collect())
            return keep(df, *rest)

        monkeypatch.setattr(module, fn, note)

    noted(jaccard, "families")
    noted(suffixes, "repeated_slots")
    jaccard.linked(frame(spark, TEXTS)).count()
    suffixes.without_repeats(frame(spark, TEXTS)).count()
    assert seen.keys() == {"families", "repeated_slots"} and all(n < 40_000 for n in seen.values()), seen
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "50000")  # a bound of the session's own holds
    try:
        assert session.in_small_batches(lambda df: df.sparkSession.conf.get(name))(spark.range(1)) == "50000"
        assert spark.conf.get(name) == "50000"
    finally:
        spark.conf.unset(name)


def test_cut_texts_pass_one_worker_a_task(spark):
    """Two functions in a chain would take two Python workers of each task."""
    plan = suffixes.deduplicated(frame(spark, TEXTS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 4  # a filter in three places, and the cut


def test_pieces_take_little_memory():
    """Arrays of a portion are some eighty times its text, and every task of an executor has its own."""
    import tracemalloc

    texts = pa.array([prose(200, n) for n in range(1500)])
    batch = pa.record_batch([texts], names=["text"])
    shingles.first_powers(2**18, shingles.MULTIPLIER), shingles.first_powers(2**18, suffixes.BACK)
    tracemalloc.start()
    n = sum(len(suffixes.Pieces(part).hash) for _, part in suffixes.portions([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and texts.nbytes > 1_000_000 and most < 40_000_000, most


def test_pieces_of_single_documents_stay_in_a_large_corpus(spark, monkeypatch):
    """Pieces travel that two documents have: slots that are full by single documents' pieces let few of these through."""
    from corpusgauge.session import written_once

    rng, seen, plain = random.Random(8), [], suffixes.packed_pieces
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(100)
    found = [(i, noise(1500) + (shared if i % 100 == 0 else "")) for i in range(400)]
    monkeypatch.setattr(suffixes, "SLOTS", 2**17)  # some 42,000 pieces
    monkeypatch.setattr(suffixes, "packed_pieces", lambda *a: seen.append(written_once(plain(*a))) or seen[-1])
    assert cut(spark, found) == brute.removals(found)
    travelled = sum(len(suffixes.unpack(bytes(r.lengths))[0]) for r in seen[0].select("lengths").collect())
    assert 0 < travelled < 1000, travelled


def test_probes_follow_how_full_a_filter_is():
    assert [suffixes.probes_for(n, 2**20) for n in (0, 1000, 2**15, 2**18, 2**21)] == [1, 1, 2, 3, 1]
