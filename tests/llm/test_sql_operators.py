"""Operators that SQL can say, against their DuckDB text on odd rows."""

import pytest
from helpers import collected, documents, duck, empty, prose

from corpusgauge.llm import host_rules, licenses, mixing
from corpusgauge.session import written_once


def mixed(docs):
    return mixing.mixture(written_once(mixing.measured(docs))).select("doc_id", "size", "source_size", "target", "taken")


def ruled(docs):
    return host_rules.verdicts(written_once(host_rules.measured(docs))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


CASES = {
    "mixing": (mixed, mixing.mixing_sql()),
    "host rules": (ruled, host_rules.host_rules_sql()),
    "licenses": (licenses.licensed, licenses.licenses_sql()),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(spark, name):
    fn, sql = CASES[name]
    assert collected(fn(documents(spark))) == duck(sql)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    assert CASES[name][0](empty(spark)).collect() == []


@pytest.mark.parametrize("name", CASES)
def test_only_nulls(spark, name):
    fn, sql = CASES[name]
    given = [(None, None, None), (1, None, None), (1, None, None)]
    assert collected(fn(documents(spark, given))) == duck(sql, given)


def test_targets_stop_at_the_cap_and_the_rest_is_shared(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sources).collect()}
    assert got["a"] == 30.0 and got[None] == 120.0  # weights 5 and 5, both capped
    assert got["b"] == pytest.approx(1400 * 2 / 3) and got["c"] == pytest.approx(1400 / 3)
    assert sum(got.values()) == pytest.approx(1550)


def test_taken_is_near_the_target_and_stable(spark, monkeypatch):
    given = [(i, prose(20 + i % 50, i), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    docs = documents(spark, given)
    once = collected(mixed(docs))
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)  # many ranges must not change the draw
    rows = mixed(docs.repartition(5))
    assert collected(rows) == once
    for r in rows.groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= r["max(size)"]
    assert rows.where("taken > 3 * size").count() == 0


def test_mixed_documents_repeat_rows_as_the_mixture_says(spark):
    given = [(i, prose(20 + i % 50, i), "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    docs = documents(spark, given)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = mixing.mixture(written_once(mixing.measured(docs))).where("copies > 0")
    assert copies == {r["doc_id"]: r["copies"] for r in want.collect()}
    assert mixing.mixed_documents(empty(spark)).collect() == []


def test_kept_documents_are_those_of_the_verdicts(spark):
    docs = documents(spark)
    out = host_rules.kept_documents(docs)
    assert out.columns == docs.columns
    keys = [(r["doc_id"], r["n_words"]) for r in ruled(docs).where("kept").collect()]
    got = [(r["doc_id"], len((r["text"] or "").split())) for r in out.collect()]
    assert len(got) == len(keys) and {k[0] for k in keys} == {g[0] for g in got}


def test_a_bad_host_is_held_to_the_bars_and_a_good_one_is_not(spark):
    word = lambda i, j: f"w{i}x{j}"
    clean = lambda i: " ".join(word(i, j) for j in range(100))
    slight = lambda i: " ".join(word(i, j) + ("#" if j % 5 == 0 else "") for j in range(100))  # noqa: E731 between the bars
    given = [(i, slight(i) if i % 10 else clean(i), "bad") for i in range(60)]
    given += [(100 + i, clean(i) if i % 20 else slight(i), "good") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in ruled(documents(spark, given)).collect()}
    assert all(got[i] == (i % 10 == 0) for i in range(60))  # its clean documents stay
    assert all(got[100 + i] for i in range(60))


def test_prior_pulls_small_hosts_to_the_others(spark):
    counts = spark.createDataFrame([("a", 1000, 100), ("b", 1000, 300), ("c", 2, 2)], "_host string, n long, failed long")
    rate = {r["_host"]: r["rate"] for r in host_rules.shrunk_rates(counts).collect()}
    assert abs(rate["a"] - 0.1) < 0.02 and abs(rate["b"] - 0.3) < 0.02 and 0.2 < rate["c"] < 1


def test_lightly_changed_template_is_found(spark):
    text = "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"
    far = "Permission is granted to any person"
    got = {r["doc_id"]: r for r in licenses.licensed(documents(spark, [(1, text, "a"), (2, far, "a")])).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["base_labels"] == "" and 0.8 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[2]["score"] == 0


@pytest.mark.parametrize("label, text", [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal"),
    ("bsd", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:"),
    ("gpl-text", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\r\n * the Free Software Foundation, either"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
])
def test_a_template_wrapped_over_lines_is_found(spark, label, text):
    before = "\n".join(f"line {i}" for i in range(45))  # the notice does not begin where a window does
    given = [(1, text, "a"), (2, f"{before}\n{text}\nand more", "a"), (3, text.replace("\n", "\n\n"), "a"), (4, "\n".join(text.split()), "a")]
    got = licenses.licensed(documents(spark, given)).collect()
    assert len(got) == 4
    for r in got:
        assert label in r["labels"].split(",") and r["score"] >= 0.8


def test_a_template_longer_than_the_step_is_found_across_windows(spark):
    long = " ".join(f"term{i}" for i in range(licenses.BLOCK + 20))
    lines = "\n".join(long.split())
    given = [(1, "x " * n + "\n" + lines, "a") for n in (0, 31, 70, 100)] + [(1, long, "a"), (1, "x " * 40 + long, "a")]
    got = licenses.licensed(documents(spark, given), [("long", 1.0, long)]).collect()
    assert [r["labels"] for r in got] == ["long"] * 6
