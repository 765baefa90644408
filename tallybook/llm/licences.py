"""Licences in texts: known sentences, then rules over the sequence of sentences.

A text is cut into sentences; of a sentence that is not known each line is tried by itself. Normalised (lower case, every
other run of characters than letters and digits one space) it either is a known licence sentence and gives its identifier,
or nothing. Rules are tried in order against the sequence of identifiers of the text, the most specific first; each match uses up
the identifiers it covers. All of it is built-in expressions in one pass; nothing is shuffled.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import text_or_empty

# Sentences of public licences and the usual notices, and their identifiers.
SENTENCES = {
    "Released under the MIT License": "MitNotice",
    "Licensed under the MIT License": "MitNotice",
    "This project is licensed under the MIT License": "MitNotice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction, including without limitation the rights"
    " to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so, subject to the following conditions": "MitGrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software": "MitKeep",
    "Licensed under the Apache License, Version 2.0": "ApacheNotice",
    "Licensed under the Apache License, Version 2.0 (the License)": "ApacheNotice",
    "you may not use this file except in compliance with the License": "ApacheComply",
    "You may obtain a copy of the License at": "ApacheCopy",
    "This work is licensed under the GNU General Public License, version 3": "Gpl3Notice",
    "This work is licensed under the GNU General Public License, version 2": "Gpl2Notice",
    "This program is free software": "GplFree",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation, either version 3 of the License, or (at your option) any later version": "Gpl3Later",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
    " Software Foundation, either version 2 of the License, or (at your option) any later version": "Gpl2Later",
    "Licensed under CC BY-NC 4.0": "CcByNc4",
    "Licensed under CC BY 4.0": "CcBy4",
    "Licensed under CC BY-SA 4.0": "CcBySa4",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met": "BsdGrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer": "BsdSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "All rights reserved": "Reserved",
}
# Rules in order: licence, and the sequence of identifiers, each in angle brackets, as a pattern.
RULES = [
    ("Apache-2.0", "<ApacheNotice>(<ApacheComply>)?(<ApacheCopy>)?"),
    ("GPL-3.0-or-later", "(<GplFree>)?<Gpl3Later>"),
    ("GPL-2.0-or-later", "(<GplFree>)?<Gpl2Later>"),
    ("GPL-3.0", "<Gpl3Notice>"),
    ("GPL-2.0", "<Gpl2Notice>"),
    ("MIT", "<MitGrant><MitKeep>"),
    ("MIT", "<MitNotice>"),
    ("BSD-2-Clause", "<BsdGrant><BsdSource><BsdBinary>"),
    ("CC-BY-NC-4.0", "<CcByNc4>"),
    ("CC-BY-SA-4.0", "<CcBySa4>"),
    ("CC-BY-4.0", "<CcBy4>"),
    ("All rights reserved", "<Reserved>"),
]
UNKNOWN = "unknown"
# A sentence ends at . ! ? : ; before white space or the end of the text.
SENTENCE_END = r"[.!?:;]+(\s|$)"


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", " "), F.lit(" "))


def _known() -> Column:
    pairs = {_plain(s): i for s, i in SENTENCES.items()}
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])


def scanned(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """doc_id, sentences (identifiers in order), licences (names in the order of the rules) for every row of ``docs``.

    ``docs`` has doc_id and text and any other columns. Identifiers that no rule uses up give ``unknown`` at the end. Null and
    empty texts have none. Repeated rows are each scanned. An empty table gives no rows.
    """
    known = _known()
    # ASCII letters only: no other letter is part of a known sentence.
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def found(sentence: Column) -> Column:
        whole = F.element_at(known, _normal(sentence))
        lines = F.transform(F.split(sentence, "\n"), lambda line: F.element_at(known, _normal(line)))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(lines))

    marked = docs.select("doc_id", F.flatten(F.transform(F.split(lower, SENTENCE_END), found)).alias("sentences"))
    rest = F.array_join(F.transform("sentences", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    marked = marked.withColumns({"rest": rest, "licences": F.array().cast("array<string>")})
    for name, pattern in rules:
        added = F.array_append("licences", F.lit(name))
        marked = marked.withColumn("licences", F.when(F.col("rest").rlike(pattern), added).otherwise(F.col("licences")))
        marked = marked.withColumn("rest", F.regexp_replace("rest", pattern, "|"))
    other = F.when(F.contains("rest", F.lit("<")), F.array(F.lit(UNKNOWN))).otherwise(F.array().cast("array<string>"))
    return marked.select("doc_id", "sentences", F.array_distinct(F.concat("licences", other)).alias("licences"))


def oracle() -> str:
    """The same in DuckDB's SQL, with sentences and licences joined by commas."""
    values = ", ".join(f"('{_plain(s)}', '{i}')" for s, i in SENTENCES.items())
    normal = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'), ' ')"
    steps = []
    for n, (name, pattern) in enumerate(RULES):
        steps.append(
            f"r{n + 1} AS (SELECT doc_id, ids, regexp_replace(rest, '{pattern}', '|', 'g') AS rest,"
            f" licences || CASE WHEN regexp_matches(rest, '{pattern}') THEN ['{name}'] ELSE [] END AS licences FROM r{n})"
        )
    return f"""
        WITH known(sentence, id) AS (SELECT DISTINCT * FROM (VALUES {values})),
        d AS (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{SENTENCE_END}') AS list FROM documents),
        s AS (SELECT doc_id, generate_subscripts(list, 1) AS i, unnest(list) AS sentence FROM d),
        m AS (SELECT s.doc_id, s.i, s.sentence, k.id FROM s LEFT JOIN known k ON k.sentence = {normal.format("s.sentence")}),
        l AS (SELECT doc_id, i, generate_subscripts(string_split(sentence, chr(10)), 1) AS j,
                     unnest(string_split(sentence, chr(10))) AS line FROM m WHERE id IS NULL),
        f AS (SELECT doc_id, i, 0 AS j, id FROM m WHERE id IS NOT NULL
              UNION ALL SELECT l.doc_id, l.i, l.j, k.id FROM l JOIN known k ON k.sentence = {normal.format("l.line")}),
        r0 AS (SELECT d.doc_id, coalesce(list(f.id ORDER BY f.i, f.j) FILTER (f.id IS NOT NULL), []) AS ids,
                      coalesce(string_agg('<' || f.id || '>', '' ORDER BY f.i, f.j), '') AS rest, []::VARCHAR[] AS licences
               FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id),
        {", ".join(steps)}
        SELECT doc_id, array_to_string(ids, ',') AS sentences,
               array_to_string(list_distinct_in_order, ',') AS licences
        FROM (SELECT *, list_filter(licences || CASE WHEN contains(rest, '<') THEN ['{UNKNOWN}'] ELSE [] END,
                  lambda x, n: list_position(licences || ['{UNKNOWN}'], x) = n OR x = '{UNKNOWN}') AS list_distinct_in_order
              FROM r{len(RULES)})
    """
