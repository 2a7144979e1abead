"""License scans by sentence rules, in DataFrame functions only.

A text is normalised (A-Z lowered, all but letters and digits to single spaces, so comment prefixes go) and cut into
sentences at line ends and marks; sentences without words don't count. Known sentences are found wherever their words follow
one another: as a sentence, as a clause of a longer one, or wrapped over lines. They are looked up, not searched for: the
first three words at a place give, by their hash, the lengths to try, and as many words give, by their hash, the identifier,
the longest first. So a scan costs the same with twenty known sentences and with thousands. What is left of a document is a short
sequence of identifiers with the numbers of the sentences where they start and end. Rules are ordered identifier sequences; a
rule matches where its identifiers come in order with at most GAP other sentences, known or not, between each two; a wrapped
sentence counts as one.

A sentence within a longer known one doesn't count, nor does a reference to a license ("released under the ...") after one of
NEGATIONS at most three words before, in its sentence. A rights reservation names no license where another license stands.
SPDX-License-Identifier lines name their licenses by themselves (of an expression, all that are known; "-only", "-or-later"
and "+" are ignored), without a sentence.

Defined results: null and empty texts have no sentences and no licenses; repeated sentences are matched each time but
a license is named once; repeated rows are scanned each by itself; an empty table gives no rows; extra columns pass; no row
moves between tasks (no shuffle). A very long text is one row's work, linear in its words.
"""

from __future__ import annotations

import json
import zlib
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences that may stand between two of a rule.
GAP = 2
#: Words of a sentence by whose hash its lengths are found.
ANCHOR = 3

# License sentences, normalised, by identifier.
SENTENCES: dict[str, str] = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "reserved": "all rights reserved",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl2_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3_free": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero_bsd_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is",
    "mpl_form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense_grant": "this is free and unencumbered software released into the public domain",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "wtfpl_grant": "you just do what the fuck you want to",
    "epl2_terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
}
# License -> ordered sentence identifiers.
RULES: dict[str, list[tuple[str, ...]]] = {
    "MIT": [("mit_grant", "mit_notice")],
    "Apache-2.0": [("apache_use", "apache_copy")],
    "GPL-3.0": [("gpl_free", "gpl_hope")],
    "GPL-2.0": [("gpl2_free", "gpl_hope")],
    "LGPL-2.1": [("lgpl2_free",)],
    "LGPL-3.0": [("lgpl3_free",)],
    "AGPL-3.0": [("agpl3_free",)],
    "BSD-2-Clause": [("bsd_use", "bsd_source", "bsd_binary")],
    "BSD-3-Clause": [("bsd_use", "bsd_source", "bsd_binary", "bsd_names")],
    "ISC": [("isc_grant",)],
    "0BSD": [("zero_bsd_grant",)],
    "MPL-2.0": [("mpl_form",)],
    "Zlib": [("zlib_grant",)],
    "Unlicense": [("unlicense_grant",)],
    "BSL-1.0": [("boost_grant",)],
    "WTFPL": [("wtfpl_grant",)],
    "EPL-2.0": [("epl2_terms",)],
}
#: The sentence that names OWN where no license stands.
RESERVED, OWN = "reserved", "Proprietary"
#: A license that isn't named where another, which holds its sentences, is.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
# License -> names, normalised. A reference is one of LEADS before a name.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit license", "mit licence", "mit x11 license", "expat license"],
    "MIT-0": ["mit no attribution license"],
    "ISC": ["isc license"],
    "0BSD": ["bsd zero clause license", "zero clause bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "4 clause bsd license"],
    "Apache-1.1": ["apache license version 1 1", "apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0"],
    "EUPL-1.1": ["european union public licence version 1 1", "european union public licence 1 1", "eupl version 1 1"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence 1 2", "eupl version 1 2"],
    "Artistic-2.0": ["artistic license version 2 0", "artistic license 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "PostgreSQL": ["postgresql license"],
    "Python-2.0": ["python software foundation license version 2"],
    "PHP-3.01": ["php license version 3 01"],
    "NCSA": ["university of illinois ncsa open source license"],
    "MS-PL": ["microsoft public license"],
    "MS-RL": ["microsoft reciprocal license"],
    "AFL-3.0": ["academic free license version 3 0"],
    "OSL-3.0": ["open software license version 3 0"],
    "ODbL-1.0": ["open database license", "open data commons open database license", "odbl 1 0"],
    "ODC-By-1.0": ["open data commons attribution license", "odc by 1 0"],
    "PDDL-1.0": ["open data commons public domain dedication and license", "pddl 1 0"],
    "GFDL-1.3": ["gnu free documentation license version 1 3"],
    "LPPL-1.3c": ["latex project public license version 1 3c"],
    "UPL-1.0": ["universal permissive license version 1 0", "universal permissive license v 1 0"],
    "SSPL-1.0": ["server side public license version 1"],
    "BUSL-1.1": ["business source license 1 1", "business source license version 1 1"],
    "Elastic-2.0": ["elastic license 2 0"],
}
# The GNU and Creative Commons families, whose names follow a rule.
for _spdx, _short, _long, _number in (
    ("GPL-2.0", "gpl", "gnu general public license", "2"), ("GPL-3.0", "gpl", "gnu general public license", "3"), ("LGPL-2.1", "lgpl", "gnu lesser general public license", "2 1"),
    ("LGPL-3.0", "lgpl", "gnu lesser general public license", "3"), ("AGPL-3.0", "agpl", "gnu affero general public license", "3"),
):
    NAMES[_spdx] = [f"{_long} version {_number}", f"{_long} v{_number}", f"{_short}v{_number}", f"{_short} v{_number}", f"{_short} version {_number}", f"gnu {_short} version {_number}"]
for _terms, _full in (("", ""), (" nc", " noncommercial"), (" sa", " sharealike"), (" nd", " noderivatives"), (" nc sa", " noncommercial sharealike"), (" nc nd", " noncommercial noderivatives")):
    for _number in ("3 0", "4 0"):
        NAMES[f"CC-BY{_terms.upper().replace(' ', '-')}-{_number.replace(' ', '.')}"] = [f"cc by{_terms} {_number}"] + [f"creative commons attribution{_full} {_number} {_where}" for _where in ("international", "unported", "license")]
LEADS = [" ".join(x).strip() for x in product(["released under", "licensed under", "distributed under", "available under", "published under"], ["", "the", "a"])]
# Identifiers of references; all others are the license in small letters, with _ between its parts.
_REFERENCES = {"MIT": "mit_ref", "Apache-2.0": "apache_ref", "GPL-2.0": "gpl2_ref", "GPL-3.0": "gpl3_ref", "CC-BY-NC-4.0": "cc_by_nc_ref", "CC-BY-4.0": "cc_by_ref"}
#: A reference after one of these, at most NEAR words before and in its sentence, is none.
NEGATIONS = ("not", "never", "longer", "neither", "isn", "wasn", "aren", "weren", "cannot")
NEAR = 3
#: Sentences end at line ends and at marks before white space.
ENDS = r"\n+|[.!?;]+[ \t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The expression after an SPDX tag, and what stands between its parts.
SPDX_LINE, SPDX_ENDS, SPDX_TAIL = r"spdx-license-identifier:[ \t]*([^\r\n]+)", r"[^a-z0-9.+-]+", r"(-only|-or-later|[+])$"


def reference_id(license: str) -> str:
    return _REFERENCES.get(license) or "".join(c if c.isalnum() else "_" for c in license.lower()) + "_ref"


def references() -> list[tuple[str, str, str]]:
    """(license, identifier, sentence) of all references."""
    return [(license, reference_id(license), f"{lead} {name}") for license, names in NAMES.items() for lead in LEADS for name in names]


def triggers() -> list[str]:
    """Few strings of which every known sentence holds one: texts without any aren't cut into words."""
    left, out = [*SENTENCES.values(), *(lead for lead in LEADS)], []
    while left:
        words = {w for s in left for w in s.split() if len(w) > 5} or {max(s.split(), key=len) for s in left}
        out.append(max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return sorted(out)


def _buckets(rows: list[dict], form: str, n: int = 1024) -> Column:
    """A constant array of small lists of rows by the CRC-32 of their key."""
    out: list[list[dict]] = [[] for _ in range(n)]
    for row in rows:
        out[zlib.crc32(row["key"].encode()) % n].append(row)
    return F.from_json(F.lit(json.dumps(out)), f"array<array<struct<key:string,{form}>>>")


def _looked_up(table: Column, key: Column, n: int = 1024) -> Column:
    """The row of a key in a table of _buckets, or null."""
    row = lambda k: F.get(F.filter(F.get(table, (F.crc32(k.cast("binary")) % n).cast("int")), lambda r: r["key"] == k), F.lit(0))
    return _once(key, row)


def _once(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


FOUND = "array<struct<id:string,first:int,last:int,license:string>>"


def known_sentences(text: Column) -> Column:
    """The known sentences of a text in order: identifier, numbers of the first and last sentence that they touch, and the license that a reference names."""
    rows = [{"key": s, "id": name, "license": None} for name, s in SENTENCES.items()] + [{"key": s, "id": name, "license": license} for license, name, s in references()]
    lengths: dict[str, set[int]] = {}
    for row in rows:
        words = row["key"].split()
        lengths.setdefault(" ".join(words[:ANCHOR]), set()).add(len(words))
    anchors = _buckets([{"key": k, "lengths": sorted(v, reverse=True)} for k, v in lengths.items()], "lengths:array<int>")
    known, longest = _buckets(rows, "id:string,license:string"), max(len(r["key"].split()) for r in rows)

    lowered = F.translate(text, UPPER + "|", LOWER + " ")
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(lowered, ENDS, "|"), "[^a-z0-9|]+", " "), "[|]"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.flatten(F.transform(parts, lambda p, u: F.transform(F.split(p, " "), lambda w: F.struct(w.alias("w"), u.alias("u")))))

    def at(ws: Column, i: Column) -> Column:
        """The longest known sentence that starts at word i."""
        tries = _looked_up(anchors, F.array_join(F.slice(ws, i, F.lit(ANCHOR))["w"], " "))["lengths"]
        each = F.transform(tries, lambda n: F.struct(n.alias("n"), _looked_up(known, F.array_join(F.slice(ws, i, n)["w"], " ")).alias("row")))
        return F.get(F.filter(each, lambda x: x["row"].isNotNull()), F.lit(0))

    def hits(ws: Column) -> Column:
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), at(ws, i).alias("hit"))), lambda x: x["hit"].isNotNull())

    def kept(ws: Column, found: Column) -> Column:
        within = lambda h, j: F.exists(
            F.slice(found, F.greatest(F.lit(1), j - longest + 1), F.least(j, F.lit(longest))), lambda g: g["i"] + g["hit"]["n"] >= h["i"] + h["hit"]["n"])
        denied = lambda h: h["hit"]["row"]["license"].isNotNull() & F.exists(
            F.slice(ws, F.greatest(F.lit(1), h["i"] - NEAR), F.least(h["i"] - 1, F.lit(NEAR))), lambda x: (x["u"] == F.get(ws, h["i"] - 1)["u"]) & x["w"].isin(*NEGATIONS))
        whole = F.filter(F.filter(found, lambda h, j: ~within(h, j)), lambda h: ~denied(h))
        return F.transform(whole, lambda h: F.struct(
            h["hit"]["row"]["id"].alias("id"), F.get(ws, h["i"] - 1)["u"].alias("first"), F.get(ws, h["i"] + h["hit"]["n"] - 2)["u"].alias("last"), h["hit"]["row"]["license"].alias("license")))

    # most texts hold none: only those with a trigger are cut
    holds = _once(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(t)) for t in triggers()]))
    return F.when(holds, _once(words, lambda ws: _once(hits(ws), lambda found: kept(ws, found)))).otherwise(F.array().cast(FOUND))


def licenses_of_tags(text: Column) -> Column:
    """The known licenses in a text's SPDX lines, null for others."""
    spdx = _buckets([{"key": name.lower(), "license": name} for name in sorted({*RULES, *NAMES})], "license:string")
    tags = F.flatten(F.transform(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(SPDX_LINE), 1), lambda e: F.split(e, SPDX_ENDS)))
    tagged = F.transform(tags, lambda t: _looked_up(spdx, F.regexp_replace(t, SPDX_TAIL, ""))["license"])
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier")), tagged).otherwise(F.array().cast("array<string>"))


def pattern(way: tuple[str, ...], gap: int = GAP) -> str:
    """A rule as a pattern over the sequence written by ``licenses``: <id> and ; at ends of sentences."""
    return rf"(?:[^;]*;){{0,{gap + 1}}}[^;]*".join(f"<{name}>" for name in way)


def licenses(found: Column, tagged: Column, gap: int = GAP) -> Column:
    """The names of the licenses whose rules match a sequence of known sentences, and of SPDX lines, sorted."""
    apart = lambda x, j: F.when(j == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(gap + 2), x["first"] - F.get(found, j - 1)["last"])))
    said = F.array_join(F.transform(found, lambda x, j: F.concat(F.repeat(F.lit(";"), apart(x, j)), F.lit("<"), x["id"], F.lit(">"))), "")
    by_rule = lambda s: F.array(*[
        F.when(_any(s, ways, gap) & ~_any(s, RULES.get(PART_OF.get(name), []), gap), F.lit(name)) for name, ways in sorted(RULES.items())])
    ruled = F.when(F.size(found) > 0, _once(said, by_rule)).otherwise(F.array().cast("array<string>"))
    named = F.array_sort(F.array_distinct(F.filter(F.concat(ruled, found["license"], tagged), lambda x: x.isNotNull())))
    own = F.exists(found, lambda x: x["id"] == RESERVED)
    return _once(named, lambda n: F.when((F.size(n) == 0) & own, F.array(F.lit(OWN))).otherwise(n))


def _any(said: Column, ways: list[tuple[str, ...]], gap: int) -> Column:
    return reduce(or_, [F.contains(said, F.lit(f"<{way[0]}>")) & (F.lit(True) if len(way) == 1 else said.rlike(pattern(way, gap))) for way in ways], F.lit(False))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentences (identifier, first and last number, license of a reference) and licenses."""
    whole = F.coalesce(docs[text], F.lit(""))
    kept = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns if c not in ("sentences", "licenses")]
    found = docs.select(*kept, known_sentences(whole).alias("sentences"), licenses_of_tags(whole).alias("licenses"))
    return found.withColumn("licenses", licenses(F.col("sentences"), F.col("licenses")))
