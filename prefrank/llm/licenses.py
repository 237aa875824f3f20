"""Licence scan by sentence rules, native.

A text is cut into sentences, each is normalised (lower case, only letters, digits and dots
inside versions, single blanks) and looked up among known licence sentences. The identifiers
found, in order, are matched against licence rules: ordered lists of identifiers that may have
other sentences between them. Only texts with a hint word are cut up at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import tidy

# Known licence sentences, normalised, and their identifiers. `{v}` stands for nothing; the table is
# plain text so that it can be read and extended.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-short",
    "licensed under the apache license version 2.0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 2": "gpl2-short",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-v3-later",
    "either version 2 of the license or at your option any later version": "gpl-v2-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
    "free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the "
    "free software foundation": "agpl-terms",
    "either version 2.1 of the license or at your option any later version": "gpl-v21-later",
    "licensed under the gnu lesser general public license version 2.1": "lgpl21-short",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "licensed under the mozilla public license version 2.0": "mpl2-short",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-grant",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by 4.0": "cc-by-4",
    "licensed under cc by sa 4.0": "cc-by-sa-4",
    "licensed under cc by nc 4.0": "cc-by-nc-4",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-4",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "cc-by-nc-4",
    "released into the public domain under cc0 1.0": "cc0",
    "all rights reserved": "proprietary",
}
# Third clause of BSD-3, with the usual holders; after a name with a stop ("Inc.") its end is a sentence of its own.
SENTENCES |= {
    f"{holder}nor the names of {its} contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission": "bsd-neither"
    for holder in ("", *(f"neither the name of {x} " for x in (
        "the copyright holder", "the copyright owner", "the copyright holders", "the author", "the authors", "the project",
        "this project", "the organization", "the company", "the university", "the institute", "the developer")))
    for its in ("its", "the", "other")
}
# Statements as README files have them.
SENTENCES |= {
    f"{head}{verb} under {terms}{name}{tail}": known
    for head in ("", "this project is ", "this software is ")
    for verb in ("licensed", "released", "distributed")
    for terms in ("the ", "the terms of the ")
    for name, known in (
        ("mit license", "mit-short"), ("apache license 2.0", "apache2-short"), ("apache license version 2.0", "apache2-short"),
        ("apache 2.0 license", "apache2-short"), ("gnu general public license v3.0", "gpl3-short"),
        ("gnu general public license version 3", "gpl3-short"), ("gnu general public license v2.0", "gpl2-short"),
        ("gnu general public license version 2", "gpl2-short"), ("mozilla public license 2.0", "mpl2-short"),
        ("bsd 3 clause license", "bsd3-short"), ("bsd 2 clause license", "bsd2-short"), ("isc license", "isc-short"))
    for tail in ("", " see the license file for details", " see the license md file for details",
                 " see the license license file for details", " see the license md license md file for details",
                 " see license for details", " see license")
}
# The GNU notices as one sentence: a comma stands before the version.
SENTENCES |= {
    f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the "
    f"free software foundation either version {version} of the license or at your option any later version": name
    for kind, version, name in (
        ("", "3", "gpl3-notice"), ("", "2", "gpl2-notice"), ("lesser ", "3", "lgpl3-notice"),
        ("lesser ", "2.1", "lgpl21-notice"), ("affero ", "3", "agpl3-notice"))
}
# Licences and the ordered sentence identifiers that show them; every rule that fits counts.
RULES = [
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("Apache-2.0", ["apache2-comply", "apache2-copy"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("GPL-3.0-or-later", ["gpl-terms", "gpl-v3-later"]),
    ("GPL-2.0-or-later", ["gpl-terms", "gpl-v2-later"]),
    ("GPL-3.0-or-later", ["gpl3-notice"]),
    ("GPL-2.0-or-later", ["gpl2-notice"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl-v3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-notice"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "gpl-v21-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-notice"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "gpl-v3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-notice"]),
    ("LGPL-2.1-only", ["lgpl21-short"]),
    ("LGPL-3.0-only", ["lgpl3-short"]),
    ("AGPL-3.0-only", ["agpl3-short"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-short"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC0-1.0", ["cc0"]),
]
#: A last sentence of a rule does not count where the first of these follows before the next of the second.
OUTRANKED = {"bsd-binary": ("bsd-neither", "bsd-grant")}
#: Every known sentence holds one of these; a text without any is not cut up.
HINTS = "licen|permission|redistribut|free software|free and unencumbered|public license|public domain|all rights reserved|" \
        "version [23] of"
#: Sentences end at stops before white space, at semicolons and colons, at blank lines, at list marks, and at line
#: breaks before a capital, digit or mark; a line that goes on in lower case belongs to its sentence. For texts whose
#: runs of blanks are one blank each; a run of stops is tried from its first one only, so time grows with the text.
SENTENCE_END = r"(?<![.!?;:])[.!?;:]++(?:\s+|$)|\n ?\n|\n ?[^a-z\s]{0,3} ?(?=[A-Z0-9])"


def normalised(sentence: Column) -> Column:
    """Lower case; runs of other characters than a-z, 0-9 and dots between digits or after a letter `v` are one blank."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+|\.(?![0-9 ])", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; repeats stay.

    Texts without a hint word are passed over for the library's own table, whose sentences all hold one.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    even = F.regexp_replace(text, r"[^\S\n]++", " ")
    # A sentence that follows a line break may begin with the break's capital: the break is not part of it.
    parts = F.transform(F.split(even, SENTENCE_END), normalised)
    # A look-up compares with the whole table: parts without a word, as between many line breaks, are spared it.
    if "" not in sentences:
        parts = F.array_remove(parts, "")
    found = F.array_compact(F.transform(parts, lambda s: F.try_element_at(known, s)))
    if sentences is not SENTENCES:
        return found
    return F.when(F.lower(text).rlike(HINTS), found).otherwise(F.array().cast("array<string>"))


def rule_fits(ids: list[str], found: Column, outranked: dict[str, tuple[str, str]]) -> Column:
    """Whether the identifiers of a rule stand in ``found`` in their order, with any others between.

    One pass over the places: ``step`` counts the rule's identifiers met so far. If the last one is outranked, the
    rule fits only if, of its two others, the first does not come next.
    """
    last = len(ids)
    rule = F.array(*[F.lit(i) for i in ids])
    above, again = outranked.get(ids[-1], (None, None))

    def after(step, own):
        going = F.when(F.get(rule, step) == own, step + 1).otherwise(step)
        if above is None:
            return F.when(step >= last, step).otherwise(going)
        waiting = F.when(own == above, F.lit(last - 1)).when(own == again, F.lit(last + 1)).otherwise(step)
        return F.when(step > last, step).when(step == last, waiting).otherwise(going)

    return F.aggregate(found, F.lit(0), after) >= last


def scan_licenses(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES,
                  rules: list[tuple[str, list[str]]] = RULES,
                  outranked: dict[str, tuple[str, str]] = OUTRANKED) -> DataFrame:
    """``docs`` with ``license_sentences`` (identifiers in order) and ``licenses`` (names, sorted, each once).

    Null and empty texts have none of either; texts of any length are read whole, in time that grows with their
    length. Columns with the added names are replaced, others pass through; every row gives one row, repeated rows
    repeated ones. Tables of sentences and rules are parameters and travel in the plan.
    """
    rows = tidy(docs, "license_sentences", "licenses")
    with_ids = rows.withColumn("license_sentences", sentence_ids(F.coalesce(F.col(text), F.lit("")), sentences))
    found = F.col("license_sentences")
    names: dict[str, Column] = {}
    for name, ids in rules:
        fits = rule_fits(ids, found, outranked)
        names[name] = names[name] | fits if name in names else fits
    fits = [F.when(fit, F.lit(name)) for name, fit in sorted(names.items())]
    some = F.when(F.size("license_sentences") > 0, F.array_compact(F.array(*fits)))
    return with_ids.withColumn("licenses", F.coalesce(some, F.array().cast("array<string>")))
