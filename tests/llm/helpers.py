"""Rows that every operator must stand, and DuckDB over them."""

from __future__ import annotations

import random

import duckdb
import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key double, size long, n long, id string, row int, token string, _k string, _row string, bucket int"
_rng = random.Random(7)
SYLLABLES = "the of and er th on ti re an he es ou le de la que con ed ing ña é ü".split()


def prose(words: int, seed: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
        out.append(word.capitalize() if i % 11 == 0 else word + ("." if i % 11 == 10 else ""))
    lines = [" ".join(out[i : i + 30]) for i in range(0, len(out), 30)]
    return "\n".join(lines)


def rows() -> list[tuple]:
    """(doc_id, text, source): clean and odd texts, copies, near copies, shared passages, ties, repeats, nulls."""
    found = [(i, prose(60 + 17 * (i % 9), i), f"s{i % 4}") for i in range(40)]
    base = prose(300, 900)
    found += [(100 + i, base, "s0") for i in range(12)]  # copies in a hot source
    for i in range(12):  # near copies
        words = base.split(" ")
        for j in range(i % 5):
            words[(37 * i + 61 * j) % len(words)] = f"w{i}x{j}"
        found.append((120 + i, " ".join(words), "s0"))
    passage = prose(70, 901)
    found += [(140 + i, prose(80, 950 + i) + " " + passage + " " + prose(40, 980 + i), "s0") for i in range(6)]
    found += [
        (200, None, "s1"), (201, "", "s1"), (202, " \t\n\r ", None), (203, None, None), (204, "one", "s2"),
        (205, "two words", "Z"), (206, "Same line here\nSame line here\nSame line here", "a"), (207, "*** ### $$$ | | |", "a"),
        (208, prose(20_000, 77), "s3"),  # very long
        (209, "a b c " * 4_000, "s3"), (210, "x" * 5_000, "s3"), (211, "é" * 400 + "中文" * 300, "s2"),
        (212, "tail blank \n\n  lead  and\ttabs \r\nend ", "s1"), (213, "<|endoftext|> in a text<|endoftext|>", "s1"),
        (214, prose(55, 214) + "\nReleased under the MIT License.\nGNU General Public License and gnu general public license", "s2"),
        (215, "Licensed under the Apache License, Version 2.0.", "s2"), (216, "CC BY-NC 4.0 and cc by", "s2"),
        (217, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software!", "s2"),
        (220, "\n".join(f"line {i}" for i in range(45)) + "\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:", "s2"),
        (221, "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated\ndocumentation files", "s2"),
        (218, "workK mit license K", "s2"), (219, "THE OF AND\x00er", "s2"),
    ]
    found += [(5, found[5][1], "s1"), (5, found[5][1], "s1"), (6, "another text under a known id", "s2")]  # repeats
    found.append((None, prose(30, 999), "s1"))
    _rng.shuffle(found)
    return found


def documents(spark, given=None, parts: int = 3):
    """The rows as a table with more columns, whose names operators might use themselves."""
    full = [
        (i, t, "en", s, None if t is None else len(t), 1.5, 7, 8, "x", 9, "tok", "k", "r", 1) for i, t, s in (rows() if given is None else given)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql: str, given=None) -> list[tuple]:
    """Rows of the SQL over the same documents, columns by name."""
    con = duckdb.connect()
    frame = pd.DataFrame(rows() if given is None else given, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}).astype({"text": object, "source": object})
    frame = frame.where(frame.notna(), None)
    con.register("frame", frame)
    con.execute("CREATE TABLE documents AS SELECT cast(doc_id AS bigint) AS doc_id, cast(text AS varchar) AS text, cast(source AS varchar) AS source FROM frame")
    cursor = con.execute(sql)
    return table([d[0] for d in cursor.description], cursor.fetchall())


def table(names, found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in found), key=repr)


def collected(df) -> list[tuple]:
    return table(df.columns, [tuple(r) for r in df.collect()])
