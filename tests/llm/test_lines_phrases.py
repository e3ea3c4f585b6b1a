"""Line dedup and collocations: the SQL on odd rows, plain loops, tries of small limits."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import collected, documents, duck, empty, prose, rows, table

from corpusgauge.llm import collocations, line_dedup, sketches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GAPS = " \t\n\x0b\x0c\r"


def lined():
    """Rows with lines that many documents have, in other cases and with other blanks around."""
    found = rows()
    shared = ["Share this page", "  all rights RESERVED\t", "", "x", "É toi", "é toi"]
    for i in range(30):
        own = [f"line {i} of its own", *[s.upper() if i % 3 == 0 else s + " " * (i % 4) for s in shared[: 1 + i % 6]]]
        own += [own[1]] * (i % 4) + ["\r" + own[1] + "\x0b"]
        found.append((300 + i, "\n".join(own), "s0"))
    return found


def lines_by_loop(given, min_docs, keep_first=False):
    def key(line):
        return line.strip(GAPS).translate(LOWER)

    where = defaultdict(set)
    for r, (_, t, _) in enumerate(given):
        for line in (t or "").split("\n"):
            where[key(line)].add(r)
    often = {k for k, rs in where.items() if k and len(rs) >= min_docs}
    order = lambda d: (d is None, d or 0)
    first = {k: min(order(given[r][0]) for r in where[k]) for k in often}
    out = []
    for d, t, _ in given:
        kept, seen, lines = [], set(), (t or "").split("\n")
        for line in lines:
            k = key(line)
            if k not in often or (keep_first and first[k] == order(d) and k not in seen):
                kept.append(line)
            seen.add(k)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_like_the_sql(spark):
    given = lined()
    got = collected(line_dedup.kept_lines(documents(spark, given)))
    assert got == duck(line_dedup.line_dedup_sql(), given)
    assert any(r[3] > 0 for r in got)


@pytest.mark.parametrize("bits", [2**10, 2**20])
def test_a_full_filter_changes_nothing(spark, bits):
    given = lined()
    got = line_dedup.without_lines(documents(spark, given), 2, bits=bits)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == lines_by_loop(given, 2)


def test_first_line_stays(spark):
    given = [r for r in lined() if r[0] not in (5, 6)]  # ids are unique here
    got = line_dedup.without_lines(documents(spark, given, parts=5), 3, keep_first=True)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == lines_by_loop(given, 3, True)


def test_only_suspected_lines_leave_their_task(spark):
    found = line_dedup.suspected(documents(spark, lined()))
    plain = Counter()
    for _, t, _ in lined():
        plain.update({x.strip(GAPS).translate(LOWER) for x in (t or "").split("\n")} - {""})
    assert found.count() == sum(n for n in plain.values() if n > 1)


def test_lines_of_no_rows(spark):
    assert line_dedup.kept_lines(empty(spark)).collect() == []


def test_filters_of_many_tasks_add_up(spark, monkeypatch):
    monkeypatch.setattr(sketches, "WIDTH", 3)
    bits, rng = 2**21, np.random.default_rng(1)
    keys = [rng.choice(bits, 500, replace=False) for _ in range(20)]
    parts = []
    for no, own in enumerate(keys):
        seen = sketches.SeenTwice(bits)
        seen.add(own)
        parts += [r for batch in seen.slices(no) for r in batch.to_pylist()]
    df = spark.createDataFrame([tuple(r.values()) for r in parts], sketches.SLICES)
    twice = sketches.twice_seen(df, len(keys), bits)
    counts = Counter(int(k) for own in keys for k in own)
    every = np.arange(bits)
    assert set(every[sketches.has(twice, every)].tolist()) == {k for k, n in counts.items() if n > 1}


# phrases


def spoken():
    found = [(i, prose(400, 40 + i % 7), "s0") for i in range(30)]
    found += [(100 + i, "New york. The new\tyork Times; new  york, a b a b a b a\nx:y!new york times", "s1") for i in range(40)]
    return [*found, *[(200 + i, " ".join(["tick tock"] * (20 + i)), "s1") for i in range(10)], *rows()[:40]]


def with_lang(spark, given, langs):
    from pyspark.sql import functions as F

    return documents(spark, given).withColumn("lang", F.get(F.array(*[F.lit(x) for x in langs]), F.coalesce(F.pmod("doc_id", F.lit(len(langs))), F.lit(0)).cast("int")))


def phrases_by_loop(given, langs, min_count, percent, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for d, t, _ in given:
        lang = langs[(d or 0) % len(langs)] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= min_count}
        rows = []
        for p, a in often.items():
            longer = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if len(p) > 1 and not any(100 * c >= percent * a for c in longer):
                score, _, left, rest = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, rest))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("langs", "percent", "top", "tiny"), [(("en",), 100, 2000, False), (("en", None, "und", "fr"), 60, 7, True), (("en", "de"), 100, 2000, True)])
def test_phrases_by_loop(spark, langs, percent, top, tiny, monkeypatch):
    if tiny:  # containers burst, subtrees are spilled and ids begin anew all the time
        for name, value in (("BURST", 30), ("BUDGET", 400), ("CHUNK", 70), ("MOST_IDS", 90)):
            monkeypatch.setattr(collocations, name, value)
    given = spoken()
    docs = with_lang(spark, given, langs)
    got = collocations.collocations(docs, 30, percent=percent, top=top)
    if tiny:  # in this process, as workers do not see the patch
        from pyspark.sql import functions as F

        plain = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("length(text) > 0").toArrow()
        counter, batches = collocations.Counter(3), []
        for lang in sorted(set(plain["lang"].to_pylist())):
            own = plain.filter(pa.compute.equal(plain["lang"], lang))["text"].combine_chunks()
            batches += list(counter.add(lang, own))
        batches += list(counter.spill(0))
        assert len(batches) > 20
        runs = pa.Table.from_batches(batches)
        merged = [collocations.phrases_of_runs(30, 5)(runs.filter(pa.compute.equal(runs["part"], p))) for p in set(runs["part"].to_pylist())]
        monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: spark.createDataFrame(pa.concat_tables(merged).combine_chunks()))
        got = collocations.collocations(docs, 30, percent=percent, top=top)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_by_loop(given, langs, 30, percent, top)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == want
    assert len(want) > 6


def test_phrases_like_the_sql(spark):
    import duckdb
    import pandas as pd

    given = spoken()
    con = duckdb.connect()
    frame = pd.DataFrame([(d, t, None if (d or 0) % 2 else "en") for d, t, _ in given], columns=["doc_id", "text", "lang"]).astype(object)
    con.register("documents", frame.where(frame.notna(), None))
    cursor = con.execute(collocations.collocations_sql(25, 80, 12))
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    got = collected(collocations.collocations(with_lang(spark, given, ("en", None)), 25, percent=80, top=12))
    assert got == want


def test_runs_cut_finer_in_rounds_change_nothing(spark, monkeypatch):
    docs = documents(spark, spoken(), parts=6)
    phrases = lambda: sorted(tuple(r) for r in collocations.frequent_phrases(docs, 30).where("words > 0").collect())
    plain = phrases()
    monkeypatch.setattr(collocations, "WIDTH", 4)
    monkeypatch.setattr(collocations, "TOGETHER", 2)
    assert phrases() == plain and len(plain) > 50


def test_words_and_pieces():
    words, pieces = collocations.words_and_pieces(pa.array([" A b.C", "", "d\x0b\x0be é;", "..", "F"]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "é", "f"]
    assert [int(p) for p in np.diff(pieces) > 0] == [0, 1, 1, 1, 0, 1]


def test_very_high_counts_stay_exact(spark):
    big = 10**16
    known = [("en", 0, "", 3 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big + 3)]
    df = spark.createDataFrame(known, collocations.FREQUENT)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "frequent_phrases", lambda *_: df)
        (row,) = collocations.collocations(empty(spark)).collect()
    assert row["score"] == 1000 * (big + 3) * 3 * big // ((big + 7) * (big + 9))


def test_phrases_of_no_rows_and_no_words(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, "a"), (2, "", "a"), (3, " .,\n", "a")])).collect() == []
    with pytest.raises(ValueError, match="words"):
        collocations.frequent_phrases(empty(spark), most=6)


def test_digest_of_the_rest_is_of_utf8(spark):
    (row,) = line_dedup.kept_lines(documents(spark, [(1, "é\n中", "s")])).collect()
    assert row["kept_sha256"] == hashlib.sha256("é\n中".encode()).hexdigest()
