"""Licence recognition by sentence rules, with DataFrame functions only.

Text is cut into sentences at line ends and at `.`, `!`, `?` or `;` before white space; a sentence is lower-cased, everything
but letters, digits and inner dots becomes one space. Known sentences have identifiers; one is found in a single line or
wrapped over several, which no sentence end, blank line or line without a word may part. What remains of a document is its
sequence of identifiers, each with the ordinals of its first and last line. A rule is an ordered list of alternatives of
identifiers: its parts must follow each other in this order with at most `gap` other sentences in between. All matches of a rule
count, but one whose sentences are a part of a longer match's is covered by it and goes.

Null and empty texts have no sentences and no licences. A repeated row gives an equal result. A very long text is one array of
sentences, from which all but the known ones are dropped at once; nothing is shuffled. Where several rules match alike all of them count,
in the order of the rules; a sentence may serve several matches. An empty table gives no rows; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of licence notices, by identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.title": "the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied",
    "apache2.licensed": "licensed under the apache license version 2.0",
    "apache2.long": "licensed under the apache license version 2.0 the license",
    "apache2.terms": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "apache2.warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl2.work": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl.v3": "either version 3 of the license or at your option any later version",
    "gpl.v2": "either version 2 of the license or at your option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "ccbync4.licensed": "licensed under cc by nc 4.0",
    "ccby4.licensed": "licensed under cc by 4.0",
    "ccbysa4.licensed": "licensed under cc by sa 4.0",
    "ccby4.long": "this work is licensed under a creative commons attribution 4.0 international license",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "reserved": "all rights reserved",
}

#: (rule, licence, parts in order); a part lists the identifiers that serve for it. Longer rules come first.
RULES = (
    ("mit.full", "MIT", (("mit.grant",), ("mit.notice",), ("mit.warranty",))),
    ("apache2.full", "Apache-2.0", (("apache2.licensed", "apache2.long"), ("apache2.terms",), ("apache2.copy",), ("apache2.warranty",))),
    ("gpl3.full", "GPL-3.0", (("gpl.free",), ("gpl.v3",), ("gpl.warranty",))),
    ("gpl2.full", "GPL-2.0", (("gpl.free",), ("gpl.v2",), ("gpl.warranty",))),
    ("bsd3.full", "BSD-3-Clause", (("bsd.redistribution",), ("bsd.endorse",))),
    ("mit.notice", "MIT", (("mit.released", "mit.licensed", "mit.title"),)),
    ("apache2.notice", "Apache-2.0", (("apache2.licensed", "apache2.long"),)),
    ("gpl3.notice", "GPL-3.0", (("gpl3.work",),)),
    ("gpl2.notice", "GPL-2.0", (("gpl2.work",),)),
    ("ccbync4.notice", "CC-BY-NC-4.0", (("ccbync4.licensed",),)),
    ("ccby4.notice", "CC-BY-4.0", (("ccby4.licensed", "ccby4.long"),)),
    ("ccbysa4.notice", "CC-BY-SA-4.0", (("ccbysa4.licensed",),)),
    ("bsd.notice", "BSD", (("bsd.redistribution",),)),
    ("reserved", "LicenseRef-all-rights-reserved", (("reserved",),)),
)

_MODIFY = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"

#: Sentences as the real texts have them, in which some of the above are longer.
WHOLE = {
    "mit.grant.whole": SENTENCES["mit.grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.warranty.whole": SENTENCES["mit.warranty"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.warranty.whole": SENTENCES["apache2.warranty"] + " without warranties or conditions of any kind either express or implied",
    "gpl3.header": f"this program is free software {_MODIFY} {SENTENCES['gpl.v3']}",
    "gpl2.header": f"this program is free software {_MODIFY} {SENTENCES['gpl.v2']}",
    "gpl3.modify": f"{_MODIFY} {SENTENCES['gpl.v3']}",
    "gpl2.modify": f"{_MODIFY} {SENTENCES['gpl.v2']}",
    "gpl.modify": _MODIFY,
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
}
_FOUNDATION = "as published by the free software foundation"
_AGAIN = "you can redistribute it and or modify it under the terms of the gnu"
_LATER = "or at your option any later version"

# Sentences of further licences, as their texts, headers and notices have them.
FURTHER = {
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc.title": "isc license",
    "bsd2.title": "bsd 2 clause license",
    "bsd2.simplified": "simplified bsd license",
    "bsd3.title": "bsd 3 clause license",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2.obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
    "mpl2.obtain.s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
    "mpl2.title": "mozilla public license version 2.0",
    "lgpl.free": "this library is free software",
    "lgpl.modify": f"{_AGAIN} lesser general public license {_FOUNDATION}",
    "lgpl.v21": f"either version 2.1 of the license {_LATER}",
    "lgpl21.header": f"this library is free software {_AGAIN} lesser general public license {_FOUNDATION} either version 2.1 of the license {_LATER}",
    "lgpl3.header": f"this program is free software {_AGAIN} lesser general public license {_FOUNDATION} either version 3 of the license {_LATER}",
    "lgpl3.library": f"this library is free software {_AGAIN} lesser general public license {_FOUNDATION} either version 3 of the license {_LATER}",
    "lgpl.warranty": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3.header": f"this program is free software {_AGAIN} affero general public license {_FOUNDATION} either version 3 of the license {_LATER}",
    "agpl3.modify": f"{_AGAIN} affero general public license {_FOUNDATION}",
    "apache2.name": "apache license",
    "apache2.version": "version 2.0 january 2004",
    "apache2.head": "apache license version 2.0 january 2004",
    "gpl.name": "gnu general public license",
    "gpl3.date": "version 3 29 june 2007",
    "gpl3.head": "gnu general public license version 3 29 june 2007",
    "gpl2.date": "version 2 june 1991",
    "gpl2.head": "gnu general public license version 2 june 1991",
    "lgpl.name": "gnu lesser general public license",
    "lgpl3.head": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21.date": "version 2.1 february 1999",
    "lgpl21.head": "gnu lesser general public license version 2.1 february 1999",
    "agpl.name": "gnu affero general public license",
    "agpl3.date": "version 3 19 november 2007",
    "agpl3.head": "gnu affero general public license version 3 19 november 2007",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0.title": "cc0 1.0 universal",
    "cc0.code": "creative commons legal code",
    "cc0.deed": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc0.work": "this work is licensed under cc0 1.0",
    "cc0.licensed": "licensed under cc0 1.0",
    "ccby4.the": "this work is licensed under the creative commons attribution 4.0 international license",
    "ccbysa4.long": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "ccbysa4.the": "this work is licensed under the creative commons attribution sharealike 4.0 international license",
    "ccbync4.long": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "ccbync4.the": "this work is licensed under the creative commons attribution noncommercial 4.0 international license",
    "epl2.header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at http www eclipse org legal epl 2.0",
    "epl2.header.s": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www eclipse org legal epl 2.0",
    "epl2.title": "eclipse public license v 2.0",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost.licensed": "distributed under the boost software license version 1.0",
}

# Identifiers that an SPDX line may name.
SPDX = """MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD MPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Unlicense CC0-1.0 CC-BY-4.0
CC-BY-SA-4.0 CC-BY-NC-4.0 EPL-2.0 Zlib BSL-1.0""".split()
NAMED = {f"spdx.{name}": f"spdx license identifier {' '.join(re.sub(r'[^a-z0-9.]+', ' ', name.lower()).split())}" for name in SPDX}
KNOWN = SENTENCES | WHOLE | FURTHER | NAMED

#: Sentences that may lie between two parts of a whole text: an address or an item's number, and comment lines without a word.
WHOLE_GAP = 6
#: Rules of RULES and for whole texts; a fourth entry is the rule's own gap.
WHOLE_RULES = (
    ("mit.full", "MIT", (("mit.grant", "mit.grant.whole"), ("mit.notice",), ("mit.warranty", "mit.warranty.whole")), WHOLE_GAP),
    ("apache2.full", "Apache-2.0", (("apache2.licensed", "apache2.long"), ("apache2.terms",), ("apache2.copy",), ("apache2.warranty", "apache2.warranty.whole")), WHOLE_GAP),
    ("gpl3.full", "GPL-3.0", (("gpl.free", "gpl.modify"), ("gpl.v3",), ("gpl.warranty",)), WHOLE_GAP),
    ("gpl3.full", "GPL-3.0", (("gpl3.header", "gpl3.modify"), ("gpl.warranty",)), WHOLE_GAP),
    ("gpl2.full", "GPL-2.0", (("gpl.free", "gpl.modify"), ("gpl.v2",), ("gpl.warranty",)), WHOLE_GAP),
    ("gpl2.full", "GPL-2.0", (("gpl2.header", "gpl2.modify"), ("gpl.warranty",)), WHOLE_GAP),
    ("bsd3.full", "BSD-3-Clause", (("bsd.redistribution",), ("bsd.source",), ("bsd.binary",), ("bsd.endorse",)), WHOLE_GAP),
    *RULES[4:],
    ("bsd2.full", "BSD-2-Clause", (("bsd.redistribution",), ("bsd.source",), ("bsd.binary",), ("bsd.warranty",)), WHOLE_GAP),
    ("bsd2.notice", "BSD-2-Clause", (("bsd2.title", "bsd2.simplified"),)),
    ("bsd3.notice", "BSD-3-Clause", (("bsd3.title",),)),
    ("bsd3.full", "BSD-3-Clause", (("bsd.redistribution",), ("bsd.source",), ("bsd.binary",), ("bsd.endorse",), ("bsd.warranty",)), WHOLE_GAP),
    ("isc.full", "ISC", (("isc.grant",), ("isc.warranty",)), WHOLE_GAP),
    ("isc.notice", "ISC", (("isc.title",),)),
    ("0bsd.full", "0BSD", (("0bsd.grant",), ("isc.warranty",)), WHOLE_GAP),
    ("mpl2.header", "MPL-2.0", (("mpl2.form",), ("mpl2.obtain", "mpl2.obtain.s")), WHOLE_GAP),
    ("mpl2.notice", "MPL-2.0", (("mpl2.title",),)),
    ("lgpl21.full", "LGPL-2.1", (("lgpl.free",), ("lgpl.modify",), ("lgpl.v21",)), WHOLE_GAP),
    ("lgpl21.header", "LGPL-2.1", (("lgpl21.header",),)),
    ("lgpl3.header", "LGPL-3.0", (("lgpl3.header", "lgpl3.library"),)),
    ("lgpl3.full", "LGPL-3.0", (("lgpl.modify",), ("gpl.v3",)), WHOLE_GAP),
    ("agpl3.header", "AGPL-3.0", (("agpl3.header",),)),
    ("agpl3.full", "AGPL-3.0", (("agpl3.modify",), ("gpl.v3",)), WHOLE_GAP),
    ("apache2.text", "Apache-2.0", (("apache2.name",), ("apache2.version",)), 1),
    ("apache2.head", "Apache-2.0", (("apache2.head",),)),
    ("gpl3.text", "GPL-3.0", (("gpl.name",), ("gpl3.date",)), 1),
    ("gpl3.head", "GPL-3.0", (("gpl3.head",),)),
    ("gpl2.text", "GPL-2.0", (("gpl.name",), ("gpl2.date",)), 1),
    ("gpl2.head", "GPL-2.0", (("gpl2.head",),)),
    ("lgpl3.text", "LGPL-3.0", (("lgpl.name",), ("gpl3.date",)), 1),
    ("lgpl3.head", "LGPL-3.0", (("lgpl3.head",),)),
    ("lgpl21.text", "LGPL-2.1", (("lgpl.name",), ("lgpl21.date",)), 1),
    ("lgpl21.head", "LGPL-2.1", (("lgpl21.head",),)),
    ("agpl3.text", "AGPL-3.0", (("agpl.name",), ("agpl3.date",)), 1),
    ("agpl3.head", "AGPL-3.0", (("agpl3.head",),)),
    ("unlicense.full", "Unlicense", (("unlicense.free",), ("unlicense.anyone",)), WHOLE_GAP),
    ("unlicense.notice", "Unlicense", (("unlicense.free",),)),
    ("cc0.text", "CC0-1.0", (("cc0.code",), ("cc0.title",)), 1),
    ("cc0.notice", "CC0-1.0", (("cc0.title", "cc0.deed", "cc0.work", "cc0.licensed"),)),
    ("ccby4.deed", "CC-BY-4.0", (("ccby4.the",),)),
    ("ccbysa4.deed", "CC-BY-SA-4.0", (("ccbysa4.long", "ccbysa4.the"),)),
    ("ccbync4.deed", "CC-BY-NC-4.0", (("ccbync4.long", "ccbync4.the"),)),
    ("epl2.header", "EPL-2.0", (("epl2.header", "epl2.header.s"),)),
    ("epl2.notice", "EPL-2.0", (("epl2.title",),)),
    ("zlib.full", "Zlib", (("zlib.warranty",), ("zlib.liable",), ("zlib.grant",)), WHOLE_GAP),
    ("boost.notice", "BSL-1.0", (("boost.licensed",),)),
    *((f"spdx.{name}", name, ((f"spdx.{name}",),)) for name in SPDX),
)

CUT = r"[\n\r]+|[.!?;](?=\s)|[.!?;]$"
#: Where no known sentence goes on: sentence ends, and a line end before a blank line.
HARD = r"(?:\r\n|\n|\r(?!\n))(?=[ \t]*[\n\r])|[.!?;](?=\s)|[.!?;]$"
#: A list item's mark at the start of a line.
ITEM = r"^[\s*#/]*\(?[0-9A-Za-z]{1,2}\)\s"
DROP = r"[^\p{L}\p{N}.]+|\.(?![0-9])"


def sentences(text: Column) -> Column:
    """The sentences of a text that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), CUT), lambda x: F.length(F.trim(x)) > 0)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), DROP, " "))


def cues(known: dict[str, str]) -> list[str]:
    """A few words of which every known sentence has one, found greedily; long words first on a tie."""
    left, chosen = [set(sentence.split()) for sentence in known.values()], []
    while left:
        words = {word for words in left for word in words}
        best = max(words, key=lambda word: (sum(word in words for words in left) * (len(word) >= 6), len(word), word))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return chosen


def known_sequence(text: Column, known: dict[str, str] = KNOWN) -> Column:
    """array<struct<at, to, id>>: the known sentences of a text with the ordinals of their first and last lines.

    A text in which none of the cue words occurs has no known sentence; its sentences are not looked at.
    """
    kind = "array<struct<at:int,to:int,id:string>>"
    names = F.create_map(*[F.lit(x) for sentence, name in sorted((s, n) for n, s in known.items()) for x in (sentence, name)])
    every = F.array(*[F.lit(sentence) for sentence in sorted(known.values())])
    most = max(len(sentence.split()) for sentence in known.values())  # lines of a wrapped one, as each has a word

    def lines(part: Column, block: Column) -> Column:
        filled = F.filter(F.split(part, r"[\n\r]+"), lambda x: F.length(F.trim(x)) > 0)
        return F.transform(filled, lambda x: F.struct(block.cast("int").alias("block"), normalised(F.regexp_replace(x, ITEM, "")).alias("words")))

    def found(at: Column, to: Column, name: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), to.cast("int").alias("to"), name.alias("id"))

    def wrapped(units: Column, unit: Column, at: Column) -> Column:
        """Known sentences that start with this whole line and end with a later one of its block."""
        ahead = F.slice(units, at + 1, F.lit(most))
        block = F.filter(ahead, lambda x: x["block"] == unit["block"])
        begun = F.filter(every, lambda sentence: F.startswith(sentence, F.concat(unit["words"], F.lit(" "))))
        runs = F.transform(F.sequence(F.lit(2), F.size(block)), lambda m: F.struct(m.alias("m"), F.array_join(F.transform(F.slice(block, F.lit(1), m), lambda x: x["words"]), " ").alias("words")))
        hits = F.transform(F.filter(runs, lambda run: F.array_contains(every, run["words"])), lambda run: found(at, at + run["m"] - 1, F.try_element_at(names, run["words"])))
        return F.when((F.length(unit["words"]) > 0) & (F.size(begun) > 0) & (F.size(block) > 1), hits).otherwise(F.array().cast(kind))

    def named(units: Column) -> Column:
        def of_line(unit: Column, at: Column) -> Column:
            single = F.filter(F.array(found(at, at, F.try_element_at(names, unit["words"]))), lambda x: x["id"].isNotNull())
            return F.concat(single, wrapped(units, unit, at))

        return F.flatten(F.transform(units, of_line))

    units = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), HARD), lines))
    hint = F.lower(text).rlike("|".join(map(re.escape, cues(known))))
    # one array for the lambdas to share: a lambda's argument is computed once, a repeated expression is not
    return F.when(hint, F.flatten(F.transform(F.array(units), named))).otherwise(F.array().cast(kind))


def _grow(sequence: Column, chains: Column, part: tuple[str, ...], gap: int) -> Column:
    """Chains with one more part: each sentence that serves for it, after every chain whose end is near enough."""

    def extended(x: Column) -> Column:
        fitting = F.filter(chains, lambda chain: (x["at"] > chain["to"]) & (x["at"] <= chain["to"] + 1 + gap))
        return F.transform(fitting, lambda chain: F.struct(F.concat(chain["at"], F.array(x["at"])).alias("at"), x["to"].alias("to")))

    return F.flatten(F.transform(F.filter(sequence, lambda x: x["id"].isin(*part)), extended))


def _matches(sequence: Column, parts, gap: int) -> Column:
    """For each match of a rule, the ordinals of its sentences."""
    chains = F.transform(F.filter(sequence, lambda x: x["id"].isin(*parts[0])), lambda x: F.struct(F.array(x["at"]).alias("at"), x["to"].alias("to")))
    for part in parts[1:]:
        chains = _grow(sequence, chains, part, gap)
    return F.transform(chains, lambda chain: chain["at"])


def _uncovered(matches: Column) -> Column:
    """Those whose sentences are not all in a longer match."""
    return F.filter(matches, lambda x: ~F.exists(matches, lambda y: (F.size(y["at"]) > F.size(x["at"])) & (F.size(F.array_except(x["at"], y["at"])) == 0)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2, known: dict[str, str] = KNOWN, rules=WHOLE_RULES) -> DataFrame:
    """One row a document: its id column, n_sentences, known (array<struct<at,to,id>>), matches (array<struct<rule,license,at>>)."""
    found = docs.select(
        F.col(id_col),
        F.size(sentences(F.col(text_col))).cast("long").alias("n_sentences"),
        known_sequence(F.col(text_col), known).alias("known"),
    )
    nothing = F.array().cast("array<struct<rule:string,license:string,at:array<int>>>")
    placed = "array<struct<place:int,at:array<int>,rule:string,license:string>>"

    def match(place: Column, at: Column, rule: Column, licence: Column) -> Column:
        return F.struct(place.alias("place"), at.alias("at"), rule.alias("rule"), licence.alias("license"))

    def tried(place: int, rule: str, licence: str, parts, own: int = gap) -> Column:
        """Matches of a rule of several parts, which are looked for where something serves for the last one."""
        hits = F.transform(_matches(F.col("known"), parts, own), lambda at: match(F.lit(place), at, F.lit(rule), F.lit(licence)))
        return F.when(F.exists("known", lambda x: x["id"].isin(*parts[-1])), hits).otherwise(F.array().cast(placed))

    of: dict[str, list[Column]] = {}  # the rules of one part, by the identifiers that serve for it
    for place, (rule, licence, parts, *_) in enumerate(rules):
        for name in parts[0] if len(parts) == 1 else ():
            of.setdefault(name, []).append(F.struct(F.lit(place).alias("place"), F.lit(rule).alias("rule"), F.lit(licence).alias("license")))
    every = [tried(place, *rule) for place, rule in enumerate(rules) if len(rule[2]) > 1]
    if of:
        single = F.create_map(*[x for name, found_ in of.items() for x in (F.lit(name), F.array(*found_))])
        alone = lambda x: F.transform(F.try_element_at(single, x["id"]), lambda r: match(r["place"], F.array(x["at"]), r["rule"], r["license"]))
        every.append(F.flatten(F.filter(F.transform("known", alone), lambda x: x.isNotNull())))
    every = F.transform(F.array_sort(F.concat(*every)), lambda x: F.struct(x["rule"].alias("rule"), x["license"].alias("license"), x["at"].alias("at")))
    matches = F.when(F.size("known") > 0, F.flatten(F.transform(F.array(every), _uncovered))).otherwise(nothing)
    return found.select(id_col, "n_sentences", "known", matches.alias("matches"))


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, rules, licenses: identifiers and distinct rules comma-joined in order, licences sorted."""
    found = scan_licenses(docs, **options)
    return found.select(
        options.get("id_col", "doc_id"),
        "n_sentences",
        F.size("known").cast("long").alias("n_known"),
        F.array_join(F.transform("known", lambda x: x["id"]), ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.transform("matches", lambda x: x["rule"])), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["license"]))), ",").alias("licenses"),
    )


def report_sql(gap: int = 2) -> str:
    """DuckDB SQL for the report: the same cuts without look-ahead, all sentences in one line, then one self-join a part of a rule, and the
    matches that no longer one covers."""
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in KNOWN.items())
    rules = []
    for place, (rule, licence, parts, *own) in enumerate(WHOLE_RULES):
        reach = 1 + (own[0] if own else gap)
        joins = "".join(f" JOIN seq s{k} ON s{k}.key = s{k - 1}.key AND s{k}.pos > s{k - 1}.pos AND s{k}.pos <= s{k - 1}.pos + {reach}" for k in range(1, len(parts)))
        where = " AND ".join(f"s{k}.id IN ({', '.join(repr(x) for x in part)})" for k, part in enumerate(parts))
        spots = ", ".join(f"s{k}.pos" for k in range(len(parts)))
        rules.append(f"SELECT s0.key, {place} AS place, '{rule}' AS rule, '{licence}' AS license, [{spots}] AS at_ FROM seq s0{joins} WHERE {where}")
    return f"""WITH d AS (SELECT row_number() OVER () AS key, doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;](\\s)', chr(1) || '\\1', 'g'), '[.!?;]$', chr(1)), '[\\n\\r]+|\\x01'), lambda x: length(trim(x)) > 0) AS parts FROM documents),
    x AS (SELECT key, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM d), k(sentence, id) AS (VALUES {known}),
    seq AS MATERIALIZED (SELECT key, pos, id FROM x JOIN k ON sentence = trim(regexp_replace(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'), '\\.([^0-9]|$)', ' \\1', 'g'))),
    m AS MATERIALIZED ({" UNION ALL ".join(rules)}),
    r AS (SELECT DISTINCT key, place, rule, license FROM m WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.key = m.key AND len(l.at_) > len(m.at_) AND list_has_all(l.at_, m.at_))),
    o AS (SELECT key, rule, min(place) AS place FROM r GROUP BY ALL)
    SELECT doc_id, len(parts)::BIGINT AS n_sentences, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses FROM d
    LEFT JOIN (SELECT key, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM seq GROUP BY key) USING (key)
    LEFT JOIN (SELECT key, string_agg(rule, ',' ORDER BY place) AS rules FROM o GROUP BY key) USING (key)
    LEFT JOIN (SELECT key, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM r GROUP BY key) USING (key)"""
