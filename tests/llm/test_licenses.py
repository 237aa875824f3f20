import random
import re
import time

from prefrank.llm.licenses import OUTRANKED, RULES, SENTENCES, rule_fits, scan_licenses
from prefrank.llm.licenses_queries import rule_pattern
from pyspark.sql import functions as F
from samples import prose

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_sentences_and_rules(spark):
    plain = prose(1, 40)
    cases = {
        1: (f"{plain}.\nReleased under the MIT License.", ["mit-short"], ["MIT"]),
        2: (f"{plain}\nLicensed under CC BY-NC 4.0.", ["cc-by-nc-4"], ["CC-BY-NC-4.0"]),
        3: (f"{plain}.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License. {plain}",
            ["apache2-short", "mit-short"], ["Apache-2.0", "MIT"]),
        4: (MIT, ["mit-title", "mit-grant", "mit-notice"], ["MIT"]),
        5: ("A licence we license to nobody.", [], []), 6: (plain, [], []), 7: (None, [], []), 8: ("", [], []),
        9: ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software. Permission is hereby granted, free of charge, to any person obtaining a copy.",
            ["mit-notice", "mit-grant"], []),
    }
    docs = spark.createDataFrame([(i, c[0], "old") for i, c in cases.items()], "doc_id int, text string, licenses string")
    got = {r.doc_id: (r.license_sentences, r.licenses) for r in scan_licenses(docs).collect()}
    assert got == {i: (ids, names) for i, (_, ids, names) in cases.items()}
    assert scan_licenses(docs.where("false")).count() == 0


def test_headers(spark):
    docs = spark.createDataFrame([(1, APACHE), (2, GPL)], "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert got[1] == ["Apache-2.0"] and got[2] == ["GPL-3.0-or-later"]


def test_rules_name_known_sentences():
    known = set(SENTENCES.values())
    assert all(i in known for _, ids in RULES for i in ids)
    assert rule_pattern(["a", "b"]) == ",a,(.*,)?b," and rule_pattern(["a"]) == ",a,"


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NEITHER = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_notices_clauses_and_readme_forms(spark):
    semicolon = GPL.replace("Foundation, either", "Foundation; either").replace("GNU General", "GNU Lesser General")
    cases = [
        (GPL, ["GPL-3.0-or-later"]), (GPL.replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
        (GPL.replace("GNU General", "GNU Affero General"), ["AGPL-3.0-or-later"]), (semicolon, ["LGPL-3.0-or-later"]),
        (BSD, ["BSD-2-Clause"]), (BSD + NEITHER, ["BSD-3-Clause"]),
        (BSD + NEITHER.replace("the copyright holder", "Some Company, Inc."), ["BSD-3-Clause"]),
        (BSD + "\n" + BSD + NEITHER, ["BSD-2-Clause", "BSD-3-Clause"]), (BSD + NEITHER + "\n" + BSD + NEITHER, ["BSD-3-Clause"]),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details", ["MIT"]),
        ("This software is released under the Apache License 2.0, see LICENSE.", ["Apache-2.0"]),
        ("Distributed under the terms of the MIT License.", ["MIT"]),
        ("This project is not licensed under the MIT License.", []),
    ]
    docs = spark.createDataFrame(list(enumerate(text for text, _ in cases)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert got == {i: names for i, (_, names) in enumerate(cases)}


def timed(spark, text):
    begin = time.perf_counter()
    row = scan_licenses(spark.createDataFrame([(text,)], "text string")).first()
    return time.perf_counter() - begin, row


def test_very_long_texts_take_time_in_proportion(spark):
    scan_licenses(spark.createDataFrame([("x",)], "text string")).collect()
    known = "All rights reserved.\n" * 100_000
    spent, row = timed(spark, BSD + known)
    assert spent < 8 and row.licenses == ["BSD-2-Clause"] and len(row.license_sentences) > 100_000
    for text in ("licen\n" + " " * 1_000_000 + "x", "licen" + "." * 1_000_000 + "x", "licen" + "\n" * 1_000_000, "licen\n" + "\t \n" * 300_000,
                 "licen" + " \r" * 500_000 + "\n-" * 200_000):
        spent, row = timed(spark, text)
        assert spent < 8 and row.licenses == []


def test_parts_without_a_word_are_not_looked_up(spark):
    plan = scan_licenses(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().analyzed().toString()
    assert "array_remove(transform(split(" in plan


def test_other_tables(spark):
    docs = spark.createDataFrame([(1, "Do as you like.\nThen pay up; or else."), (2, "Do as you like. Never mind. Then pay up."),
                                  (3, "Then pay up. Do as you like."), (4, None), (4, None)], "doc_id int, text string")
    sentences = {"do as you like": "like", "then pay up": "pay", "never mind": "mind", "or else": "else"}
    found = scan_licenses(docs, sentences=sentences, rules=[("L", ["like", "pay"]), ("P", ["pay"])], outranked={}).collect()
    assert sorted((r.doc_id, r.licenses) for r in found) == [(1, ["L", "P"]), (2, ["L", "P"]), (3, ["P"]), (4, []), (4, [])]
    above = scan_licenses(docs, sentences=sentences, rules=[("P", ["pay"])], outranked={"pay": ("else", "mind")}).collect()
    assert sorted((r.doc_id, r.licenses) for r in above) == [(1, []), (2, ["P"]), (3, ["P"]), (4, []), (4, [])]


def test_rules_fit_as_their_patterns_do(spark):
    rng = random.Random(3)
    ids = sorted(set(SENTENCES.values()))
    hot = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither"]
    rows = [(i, [rng.choice(hot if rng.random() < 0.8 else ids) for _ in range(rng.randrange(0, 12))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, found array<string>")
    for name, rule in RULES:
        got = {r.i: r.fit for r in df.select("i", rule_fits(rule, F.col("found"), OUTRANKED).alias("fit")).collect()}
        want = {i: bool(re.search(rule_pattern(rule), "," + ",".join(found) + ",")) for i, found in rows}
        assert got == want, name
