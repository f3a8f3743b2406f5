import re

import duckdb

from markhive.llm import licenses

from .conftest import ODD, SCHEMA, frame


def best_of(words: list[str], known) -> tuple | None:
    own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    tried = []
    for place, (name, template) in known:
        other = set(licenses.template_bigrams(template))
        dice = 2 * len(own & other) / (len(own) + len(other))
        if dice >= licenses.LEAST:
            tried.append((-dice, place, name))
    return min(tried, default=None)


def plain(text: str | None):
    known = list(enumerate(licenses.KNOWN))
    all_words = lambda t: re.findall("[a-z0-9]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    lines = (text or "").split("\n")
    found = [b for unit in lines + [text] * (len(lines) > 1) if (b := best_of(all_words(unit), known))]
    words, windows = all_words(text), []
    for place, (name, template) in known:
        n, own = len(licenses.template_words(template)), set(licenses.template_bigrams(template))
        for i in range(len(words) - 1):
            if f"{words[i]} {words[i + 1]}" in own and (b := best_of(words[i : i + n], [(place, (name, template))])):
                windows.append(b)
    best = min(found + windows, default=None)
    return (*((best[2], -best[0]) if best else (None, None)), len(found), len(windows))


MIT = licenses.TEXTS["MIT"]
TEXTS = {
    1: "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text here",
    2: "released under the mit license",
    3: "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.",
    4: "This software is licensed under the GNU General Public License, version 3 or later.",
    5: "licensed under the apache license version 2 0 licensed under the apache license version 2 0",
    6: "Redistribution and use in source and binary forms,\nwith or without modification, are permitted",
    7: "the license", 8: "MIT", 9: "é Licensed under CC BY-NC 4.0 é", 10: None,
    11: "Copyright (c) 2024 Acme Corp. Released under the MIT License. All else is reserved, and more words follow here.",
    12: "/* Licensed under the Apache License,\n * Version\n * 2.0 (the License); you may not use this file except in compliance */\nint main() { return 0; } " + "x = x + 1; " * 50,
    13: "Before. " * 300 + "\n".join(MIT.split(", ")) + " after" * 300, 14: MIT.replace("Software", "Program") + " and so on", 15: MIT[: len(MIT) // 3] * 2,
    16: "Released under the MIT License " * 40, 17: " ".join(licenses.TEXTS.values()), 18: "of the software and the license of the software is in the software " * 30,
}


def test_small_texts(spark):
    rows = {r.doc_id: (r.license, r.dice, r.n_units, r.n_windows) for r in licenses.scan(frame(spark, TEXTS)).collect()}
    assert rows == {i: plain(t) for i, t in TEXTS.items()}
    assert rows[1][0] == "Apache-2.0" and rows[6][0] == "BSD-3-Clause" and rows[9][0] == "CC-BY-NC-4.0" and rows[7][0] is None
    # inside a line, over several lines, and a whole licence text inside a longer one
    assert rows[11][0] == "MIT" and rows[12][0] == "Apache-2.0" and rows[13][:2] == ("MIT", 1.0) and rows[15][0] is None and rows[18][0] is None


def test_every_template_finds_itself(spark):
    texts = {k: f"Some words. {t} Other words." for k, (_, t) in enumerate(licenses.KNOWN)}
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert all(rows[k].dice == 1.0 and rows[k].n_windows > 0 for k in texts)
    assert {k: rows[k].license for k in texts if len(licenses.template_words(texts[k])) > 60} == {k: n for k, (n, t) in enumerate(licenses.KNOWN) if len(licenses.template_words(texts[k])) > 60}


def test_odd_rows_equal_sql(spark, odd, empty, tmp_path):
    rows = [*ODD, *((i, t, None, None, None) for i, t in TEXTS.items())]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "documents.parquet")
    df.toPandas().astype({"doc_id": "Int64"}).to_parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    assert sorted(map(str, map(tuple, licenses.scan(df).collect()))) == sorted(map(str, con.sql(licenses.oracle_sql()).fetchall()))
    assert licenses.scan(empty).count() == 0
