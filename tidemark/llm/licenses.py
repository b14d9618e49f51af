"""License scans: sentences are recognised one by one, and ordered rules name a licence from runs of recognised sentences.

A text is cut into sentences at line ends and after ``.``, ``!``, ``?`` or ``;`` before white space. A known sentence may run over any
number of pieces, wrapped at any width and with blank lines between; it starts and ends where a piece does. Normalisation keeps
lower-case letters, digits and inner dots, hyphens and plus signs. The identifiers of recognised sentences, in text order, are matched against the rules in their order; a rule asks
for its identifiers next to each other. All of it is done by column functions inside the row: no shuffle, no Python.

Defined results: a null or empty text, or one without a known sentence, has licence ``none``; known sentences that no rule covers give
``unknown``; a sentence that occurs several times is listed each time. Rows are never dropped, other columns never read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2",
    "licensed under the apache license version 2.0 the license": "apache2",
    "spdx-license-identifier apache-2.0": "apache2-spdx",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "spdx-license-identifier mit": "mit-spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "licensed under the gnu general public license version 2": "gpl2",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2",
    "licensed under cc by 4.0": "cc-by",
    "licensed under cc by-sa 4.0": "cc-by-sa",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}

# Whole sentences of the standard texts, of which the table above holds a fragment or another wording.
WHOLE = {
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "mit-grant",
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.': "as-is",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-notice",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-names",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
}

# Rules over identifiers that only whole sentences have; they are tested first.
WHOLE_RULES = [("GPL-3.0-or-later", ["gpl3-notice"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"])]

# Rules in the order of testing; the licence, and the identifiers that must stand next to each other.
RULES = [
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-later"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("LGPL", ["lgpl-grant"]),
    ("Apache-2.0", ["apache2", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache2"]),
    ("Apache-2.0", ["apache2-spdx"]),
    ("MPL-2.0", ["mpl2"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit"]),
    ("MIT", ["mit-spdx"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["reserved"]),
]

# Every known sentence holds one of these words, so a text without them needs no cutting. No line end can part them.
WORDS = "licen|permission|redistribut|copyright|warrant|domain|reserved"

CUT = r"\n|[.!?;][ \t\r]+"


# How the operator normalises a text, step by step; what is left are words with one blank, or one line end between pieces.
STEPS = [(CUT, "\n"), (r"[^a-z0-9.+\n-]+", " "), (r"(?<![a-z0-9])[.+-]+|[.+-]+(?![a-z0-9])", " "), (r"[ ]*\n[ \n]*", "\n"), (r"[ ]+", " "), (r"^[ \n]+|[ \n]+$", "")]


def plain(text: str) -> str:
    """A known sentence as ``STEPS`` leave it, on one line."""
    text = text.lower()
    for pattern, by in STEPS:
        text = re.sub(pattern, by, text)
    return text.replace("\n", " ")


def normalised(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def known_sentences() -> dict[str, str]:
    """Normalised sentences, short ones first, and their identifiers."""
    return dict(sorted(((plain(s), i) for s, i in (SENTENCES | WHOLE).items()), key=lambda x: (len(x[0].split()), x)))


def sentence_ids(text: Column) -> Column:
    """Array of the identifiers of the recognised sentences of a text, in text order. Sentences may overlap; the shortest at a place counts."""
    table = known_sentences()
    known = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    either = "|".join(r"[ \n]".join(map(re.escape, s.split())) for s in table)
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.concat(F.lit("\n"), normalised(F.when(F.lower(body).rlike(WORDS), body).otherwise(F.lit(""))))
    found = F.regexp_extract_all(lines, F.lit(rf"\n(?=({either})(?:\n|$))"), F.lit(1))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence of every text: the first rule that matches, all licences that match, and the identifiers found."""
    rows = docs.select(F.col(id_col), sentence_ids(F.col(text_col)).alias("ids")).withColumn("line", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))

    def matches(sequence: list[str]) -> Column:
        return F.col("line").contains("," + ",".join(sequence) + ",")

    hits = F.array_compact(F.array(*[F.when(matches(sequence), F.lit(name)) for name, sequence in WHOLE_RULES + RULES]))
    none = F.when(F.size("ids") == 0, F.lit("none")).otherwise(F.lit("unknown"))
    rows = rows.withColumn("hits", F.array_distinct(hits))
    return rows.select(
        id_col,
        F.coalesce(F.get("hits", F.lit(0)), none).alias("licence"),
        F.array_join("hits", "+").alias("licences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
    )


def oracle_sql() -> str:
    """The same scan in DuckDB, by another way: runs of pieces of any length are looked up whole, without a filter of key words.

    Known sentences enter as they are written and are normalised by SQL; a run may be as long as the longest of them has words.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in (SENTENCES | WHOLE).items())
    rules = ", ".join(f"({n}, {quote(name)}, {quote(',' + ','.join(seq) + ',')})" for n, (name, seq) in enumerate(WHOLE_RULES + RULES))

    def words(c: str) -> str:
        spaced = f"regexp_replace(' ' || lower({c}) || ' ', '[^a-z0-9.+-]+', '  ', 'g')"
        return f"trim(regexp_replace(regexp_replace(regexp_replace({spaced}, ' [.+-]+', ' ', 'g'), '[.+-]+ ', ' ', 'g'), ' +', ' ', 'g'))"

    return f"""
        with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as body from documents),
        known as materialized (
            select words as s, id, len(string_split(words, ' ')) as n_words, min(len(string_split(words, ' '))) over (partition by words) as least
            from (select {words('w')} as words, i as id from (values {known}) as k(w, i))),
        starts as (select distinct string_split(s, ' ')[1] as head from known),
        longest as (select max(n_words) as most from known),
        cut as (select row, list_filter(list_transform(regexp_split_to_array(body, '\n|[.!?;][ \t\r]+'), lambda x: {words('x')}), lambda x: x <> '') as p from docs),
        places as (select row, p, i from cut, unnest(range(1, len(p) + 1)) as u(i) where string_split(p[i], ' ')[1] in (select head from starts)),
        runs as (select row, i, n, array_to_string(list_slice(p, i, i + n - 1), ' ') as s
            from places, unnest(range(1, least(len(p) - i + 1, (select most from longest)) + 1)) as v(n)),
        rules(n, name, line) as (values {rules}),
        found as (select row, i, first(id order by n) as id from runs join known using (s) group by row, i),
        lines as (select row, string_agg(id, ',' order by i) as ids, count(*) as n from found group by row),
        hits as (select row, name, min(r.n) as first from lines, rules r where contains(',' || ids || ',', r.line) group by row, name),
        named as (select row, first(name order by first) as licence, string_agg(name, '+' order by first) as licences from hits group by row)
        select doc_id, coalesce(licence, case when ids is null then 'none' else 'unknown' end) as licence,
            coalesce(licences, '') as licences, coalesce(ids, '') as sentence_ids, coalesce(n, 0) as n_sentences
        from docs left join lines using (row) left join named using (row)"""
