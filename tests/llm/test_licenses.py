"""Whole licence texts and headers, wrapped at two widths, each recognised as itself only."""

from __future__ import annotations

import textwrap

import pytest

from corpusloom.llm import licenses
from tests.compare import oracle, spark_rows

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
FREE = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n\nThis {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
TEXTS = {
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format(ENDORSE),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1": FREE.format("library", "Lesser ", "2.1", "library"),
    "LGPL-3.0": FREE.format("program", "Lesser ", "3", "program"),
    "AGPL-3.0": FREE.format("program", "Affero ", "3", "program"),
    "GPL-3.0": FREE.format("program", "", "3", "program"),
    "GPL-2.0": FREE.format("program", "", "2", "program"),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
HEADS = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(block.split()), width, break_long_words=False, break_on_hyphens=False) for block in text.split("\n\n"))


def found(spark, rows):
    return {r.doc_id: r.licenses for r in licenses.license_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("width", [10_000, 72, 30])
def test_each_text_is_itself_only(spark, width):
    got = found(spark, [(name, "Some Title\n\nCopyright (c) 2020 Some One\n\n" + wrapped(text, width) + "\n\nand more.") for name, text in TEXTS.items()])
    assert got == {name: name for name in TEXTS}


def test_heads_and_identifiers(spark):
    assert found(spark, list(HEADS.items())) == {name: name for name in HEADS}
    lines = [(name, f"#!/bin/sh\n{mark} SPDX-License-Identifier: {name}{end}\nset -e\n") for (mark, end) in (("#", ""), ("//", ""), ("/*", " */")) for name in licenses.SPDX]
    assert found(spark, lines) == {name: name for name in licenses.SPDX}


def test_every_chain_is_kept(spark):
    """Two first parts are near enough to one second part: two matches."""
    docs = spark.createDataFrame([(1, "one. one. two. "), (2, "one. x. x. x. two. ")], "doc_id int, text string")
    scan = licenses.scan_licenses(docs, known={"k1": "one", "k2": "two"}, rules=(("r", "L", (("k1",), ("k2",))),))
    assert {r.doc_id: [m["at"] for m in r.matches] for r in scan.collect()} == {1: [[0, 2], [1, 2]], 2: []}


def test_awkward_table(awkward, nothing):
    got = licenses.license_report(awkward).collect()
    assert len(got) == awkward.count() and licenses.license_report(nothing).collect() == []
    assert {r.licenses for r in got if r.doc_id in (900, 901, 902, 903)} == {""}


def test_oracle_knows_every_sentence_in_one_line(spark, sf, tmp_path):
    rows = [(at, wrapped(text, 100_000).replace("\n\n", "\n")) for at, text in enumerate([*TEXTS.values(), *HEADS.values()])]
    docs = spark.createDataFrame([(at, text, "en", "s", len(text)) for at, text in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    mine = spark_rows(licenses.license_report(docs).select("doc_id", "n_sentences", "licenses"))
    theirs = oracle(f"SELECT doc_id, n_sentences, licenses FROM ({licenses.report_sql()})", str(tmp_path))
    assert mine == theirs
