"""Licence sentences as they stand in real files."""

import re

import pytest

from tidemark.llm import licenses


def scanned(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["licence"], r["sentence_ids"]) for r in licenses.scan(df).orderBy("doc_id").collect()]


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""


def test_sentences_wrapped_at_any_width(spark):
    narrow = re.sub(" ", "\n\n# ", GPL2)
    assert scanned(spark, GPL2, narrow, LGPL) == [("GPL-2.0-or-later", "gpl-grant,gpl2-later")] * 2 + [("LGPL", "lgpl-grant")]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
STANDARD = [
    ("MIT", MIT), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("GPL-3.0-or-later", GPL3), ("GPL-2.0-or-later", GPL2), ("LGPL", LGPL),
    ("LGPL", GPL3.replace("program", "library").replace("GNU ", "GNU Lesser ")), ("Apache-2.0", APACHE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-4.0", CC.format("")), ("CC-BY-SA-4.0", CC.format("-ShareAlike")), ("CC-BY-NC-4.0", CC.format("-NonCommercial")),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Proprietary", "All rights reserved."),
]


def test_every_rule_names_its_standard_text(spark):
    assert {name for name, _ in licenses.WHOLE_RULES + licenses.RULES} == {name for name, _ in STANDARD}
    assert [x[0] for x in scanned(spark, *[t for _, t in STANDARD])] == [name for name, _ in STANDARD]


def test_texts_are_not_lost_before_cutting(spark):
    texts = ["All rights\nreserved.", "All rights\treserved.", "This is free and unencumbered software released into the public\ndomain.", "All  rights  reserved."]
    assert [x[0] for x in scanned(spark, *texts)] == ["Proprietary", "Proprietary", "Unlicense", "Proprietary"]
    assert all(re.search(licenses.WORDS, s) for s in licenses.known_sentences())


@pytest.mark.parametrize("mark", ["-- ", "--", "- ", "+ ", "# ", "// ", " * ", "> ", "... "])
def test_comment_and_list_marks(spark, mark):
    text = f"{mark}Licensed under the MIT License.\n{mark}This Source Code Form is subject to the terms of the Mozilla Public\n{mark}License, v. 2.0."
    assert scanned(spark, text) == [("MPL-2.0", "mit,mpl2")]
