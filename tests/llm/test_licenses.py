from lacuna.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    """Dice of every line, paragraph and the text with every template, without bounds."""
    best = None
    lines = (text or "").split("\n")
    units, block = list(lines), []
    for line in [*lines, ""]:
        if licenses.words(line):
            block.append(line)
        else:
            units.append("\n".join(block))
            block = []
    for unit in [*units, text or ""]:
        a = licenses.bigrams(licenses.words(unit))
        for name, template in licenses.TEMPLATES:
            b = licenses.bigrams(licenses.words(template))
            if a:
                dice = 2 * (a & b).total() / (a.total() + b.total())
                if dice >= licenses.THRESHOLD and (best is None or dice > best[1]):
                    best = (name, dice)
    return best


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_licenses(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (None if r.license is None else (r.license, r.dice)) == want
    assert any(r.license for r in rows)


def test_odd_texts(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, None), (2, ""), (3, "x\n" + mit.replace(", ", ",\n") + "\n\ny"), (4, "released UNDER the MIT license!"), (5, "word " * 100_000), (5, "word " * 100_000), (None, "Licensed under CC BY-SA 4.0")]
    df = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(df, ["doc_id"]).collect()
    best = {r.doc_id: r.matches[0].license if r.matches else None for r in got}
    assert len(got) == 7 and best == {1: None, 2: None, 3: "MIT", 4: "MIT", 5: None, None: "CC-BY-SA-4.0"}
    assert licenses.scan(df.limit(0), ["doc_id"]).collect() == []


def test_headers_and_notices_inside_longer_units():
    held = licenses.Templates()
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    texts = {
        "AGPL-3.0": gnu.format("program", ":", "Affero General Public License", ",", "3"),
        "GPL-2.0": gnu.format("program", ";", "General Public License", ";", "2"),
        "LGPL-2.1": gnu.format("library", ";", "Lesser General Public License", ";", "2.1"),
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "MIT": "Copyright 2020 the contributors. Released under the MIT License. See the file for details.",
    }
    for name, text in texts.items():
        assert licenses.scan_text(text, held)[0][0] == name
        longer = "rain falls " * 200 + "\n" + "one more word here " * 30 + text + " and so on" * 40
        assert [(m[0], m[2], m[3]) for m in licenses.scan_text(longer, held)] == [(name, 1, 1)]
    assert licenses.scan_text("the license of the river is free of charge", held) == []
