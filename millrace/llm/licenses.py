"""License scans by sentence rules.

A text is cut into paragraphs at blank lines. A paragraph is cut into sentences, either with every new
line as an end or with new lines as spaces (wrapped notices), whichever finds more that is known. Each
sentence is normalised: lower case, letters and digits, single spaces, and the name of a copyright
holder is a placeholder. Sentences that are known get their identifier; the others vanish. Titles of
licences are known sentences too, so a whole licence text is recognised by its head. The identifiers of
a text, in order, are matched against the rules in their order: a rule is a sequence of identifiers that must follow each
other, longer and more exact ones first, and what a rule has matched no later rule sees again.

All of it is one projection of DataFrame functions over each row: no shuffle, no state, no Python.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit_short": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache_short": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"],
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache_warranty": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "gpl3_short": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
        "spdx license identifier gpl 3 0 only",
        "spdx license identifier gpl 3 0 or later",
    ],
    "gpl2_short": [
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
        "spdx license identifier gpl 2 0 only",
        "spdx license identifier gpl 2 0 or later",
    ],
    "gpl2_terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ],
    "lgpl21_short": ["licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"],
    "lgpl21_terms": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"
    ],
    "lgpl3_short": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"],
    "lgpl3_terms": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "agpl3_short": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"],
    "agpl3_terms": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl_library": ["this library is free software"],
    "mpl_terms": ["this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license version 2 0"],
    "mpl_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mpl_short": ["licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "isc_grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "isc_short": ["licensed under the isc license", "released under the isc license", "spdx license identifier isc"],
    "bsd2_short": ["licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd3_short": ["licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "epl_short": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "licensed under the eclipse public license 2 0",
        "spdx license identifier epl 2 0",
    ],
    "gpl3_terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl_program": ["this program is free software"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl_implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc_by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_zero": ["licensed under cc0 1 0", "this work is dedicated to the public domain"],
    "rights": ["all rights reserved"],
    "gpl1_title": ["gnu general public license version 1 february 1989"],
    "gpl2_title": ["gnu general public license version 2 june 1991"],
    "gpl3_title": ["gnu general public license version 3 29 june 2007"],
    "lgpl2_title": ["gnu library general public license version 2 june 1991"],
    "lgpl21_title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl3_title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl3_title": ["gnu affero general public license version 3 19 november 2007"],
    "gfdl12_title": ["gnu free documentation license version 1 2 november 2002"],
    "gfdl13_title": ["gnu free documentation license version 1 3 3 november 2008"],
    "mpl11_title": ["mozilla public license version 1 1"],
    "mpl20_title": ["mozilla public license version 2 0"],
    "apache_title": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "artistic_title": ["the artistic license"],
    "artistic2_title": ["the artistic license 2 0"],
    "cc_zero_title": ["cc0 1 0 universal"],
    "epl2_title": ["eclipse public license v 2 0"],
}

# Rules in their order, (licence, identifiers that follow each other).
RULES = [
    ("MIT", ("rights", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", ("rights", "mit_grant", "mit_notice")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_short",)),
    ("Apache-2.0", ("apache_short", "apache_use", "apache_copy", "apache_warranty")),
    ("Apache-2.0", ("apache_short", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_short",)),
    ("AGPL-3.0", ("gpl_program", "agpl3_terms", "gpl_hope", "gpl_implied")),
    ("AGPL-3.0", ("agpl3_terms",)),
    ("AGPL-3.0", ("agpl3_short",)),
    ("LGPL-2.1", ("gpl_library", "lgpl21_terms", "gpl_hope", "gpl_implied")),
    ("LGPL-2.1", ("lgpl21_terms",)),
    ("LGPL-2.1", ("lgpl21_short",)),
    ("LGPL-3.0", ("gpl_library", "lgpl3_terms", "gpl_hope", "gpl_implied")),
    ("LGPL-3.0", ("lgpl3_terms",)),
    ("LGPL-3.0", ("lgpl3_short",)),
    ("GPL-2.0", ("gpl_program", "gpl2_terms", "gpl_hope", "gpl_implied")),
    ("GPL-2.0", ("gpl_program", "gpl2_terms")),
    ("GPL-2.0", ("gpl2_terms",)),
    ("GPL-2.0", ("gpl2_short",)),
    ("GPL-3.0", ("gpl_program", "gpl3_terms", "gpl_hope", "gpl_implied")),
    ("GPL-3.0", ("gpl_program", "gpl3_terms")),
    ("GPL-3.0", ("gpl3_terms",)),
    ("GPL-3.0", ("gpl3_short",)),
    ("BSD-3-Clause", ("rights", "bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("rights", "bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd3_short",)),
    ("BSD-2-Clause", ("bsd2_short",)),
    ("MPL-2.0", ("mpl_terms", "mpl_copy")),
    ("MPL-2.0", ("mpl_terms",)),
    ("MPL-2.0", ("mpl_short",)),
    ("ISC", ("rights", "isc_grant")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_short",)),
    ("EPL-2.0", ("epl_short",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC0-1.0", ("cc_zero",)),
    ("GPL-1.0", ("gpl1_title",)),
    ("GPL-2.0", ("gpl2_title",)),
    ("GPL-3.0", ("gpl3_title",)),
    ("LGPL-2.0", ("lgpl2_title",)),
    ("LGPL-2.1", ("lgpl21_title",)),
    ("LGPL-3.0", ("lgpl3_title",)),
    ("AGPL-3.0", ("agpl3_title",)),
    ("GFDL-1.2", ("gfdl12_title",)),
    ("GFDL-1.3", ("gfdl13_title",)),
    ("MPL-1.1", ("mpl11_title", "apache_copy", "rights")),
    ("MPL-1.1", ("mpl11_title",)),
    ("MPL-2.0", ("mpl20_title",)),
    ("Apache-2.0", ("apache_title",)),
    ("Artistic-1.0", ("artistic_title",)),
    ("Artistic-2.0", ("artistic2_title",)),
    ("CC0-1.0", ("cc_zero_title",)),
    ("EPL-2.0", ("epl2_title",)),
    ("Proprietary", ("rights",)),
]


# The tag in front of a licence's short name; a holder's name and what stands for it.
TAG = "spdx-license-identifier:"
HOLDER = r"neither the names? of (?:(?!nor the names)[a-z0-9 ])+nor the names of (?:its|their|any) contributors"
HOLDER_KNOWN = "neither the name of the copyright holder nor the names of its contributors"
#: Where paragraphs end, and what a wrapped one ends its sentences with.
PARAGRAPH = r"\n\s*\n"
#: Each known sentence holds one of these, so a text without them is not cut.
TRIGGERS = ("licen", "software", "permission", "redistribut", "warrant", "rights", "copyright", "copy", "domain", "cc0")
if missed := [s for known in SENTENCES.values() for s in known if not any(t in s for t in TRIGGERS)]:
    raise ValueError(f"sentences without a trigger: {missed}")


def _known(paragraph: Column, lines: bool) -> Column:
    """The known sentences of a paragraph in order, as one string of <identifier>. A literal | ends a sentence as well."""
    ends = r"[.!?;:]+(?=\s|$)|\n" if lines else r"[.!?;:]+(?=\s|$)"
    clean = F.regexp_replace(F.regexp_replace(paragraph, ends, "|"), r"[^a-z0-9|]+", " ")
    clean = F.regexp_replace(clean, HOLDER, HOLDER_KNOWN)
    known = F.create_map(*[F.lit(x) for name, sentences in SENTENCES.items() for s in sentences for x in (s, f"<{name}>")])
    found = F.transform(F.split(clean, r"\|"), lambda s: F.try_element_at(known, F.trim(s)))
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), "")


def sentence_ids(text: Column) -> Column:
    """The known sentences of a text in order, paragraph by paragraph. The colon of an SPDX tag, the point of "v." and that of a company in front of "nor" end no sentence."""
    low = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(TAG), F.lit(TAG.replace("-", " ").replace(":", " ")))
    low = F.regexp_replace(F.regexp_replace(low, r"\bv\.\s+", "v "), r"\b(inc|ltd|co|corp)\.\s+nor\b", "$1 nor")
    both = F.transform(F.split(low, PARAGRAPH), lambda p: F.struct(_known(p, True).alias("a"), _known(p, False).alias("b")))
    return F.array_join(F.transform(both, lambda p: F.when(F.length(p["b"]) > F.length(p["a"]), p["b"]).otherwise(p["a"])), "")


def _matched(ids: Column) -> Column:
    """array<struct<rule, times>>: how often each rule matches, rules in order."""
    rest, out = ids, []
    for number, (_, sequence) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in sequence)
        after = F.replace(rest, F.lit(pattern), F.lit("#"))
        times = ((F.length(rest) - F.length(after)) / (len(pattern) - 1)).cast("int")
        out.append(F.struct(F.lit(number).alias("rule"), times.alias("times")))
        rest = after
    return F.array(*out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, sentences (identifiers in order), n_matches, licenses (array, in the order of the rules).

    Null and empty texts have no licences; equal rows, and rows that share an id, are each returned. Other
    columns, whatever their names, are not read. An empty table gives an empty frame.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    any_known = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in TRIGGERS])
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.when(any_known, sentence_ids(F.col(text))).otherwise("").alias("sentences"))
    none = F.array().cast("array<struct<rule: int, times: int>>")
    # Most texts hold no known sentence; the rules are tried on the others only.
    rules = F.when(F.col("sentences") != "", F.filter(_matched(F.col("sentences")), lambda x: x["times"] > 0)).otherwise(none)
    found = ids.select("doc_id", "sentences", rules.alias("rules"))
    total = F.aggregate("rules", F.lit(0).cast("long"), lambda s, x: s + x["times"])
    names = F.array(*[F.lit(name) for name, _ in RULES])
    return found.select("doc_id", "sentences", total.alias("n_matches"), F.array_distinct(F.transform("rules", lambda x: names[x["rule"]])).alias("licenses"))


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (joined by commas) of each document."""
    return scan(docs).select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"))
