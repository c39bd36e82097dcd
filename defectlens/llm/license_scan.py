"""Licence scan by sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Known licence sentences, normalised (lower case, runs of other characters than a-z and 0-9 as one space).
SENTENCES = {
    "apache2_short": "licensed under the apache license version 2 0",
    "apache2_the": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_short": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache2": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 only",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "all_rights": "all rights reserved",
}
# The address in the Apache header stands alone, or runs into the sentence before or after it, by line breaks and comment signs.
SENTENCES["apache2_obtain"] = "you may obtain a copy of the license at"
for _end, _scheme in (("", "http"), ("_s", "https")):
    SENTENCES[f"apache2_url{_end}"] = f"{_scheme} www apache org licenses license 2 0"
    SENTENCES[f"apache2_copy{_end}"] = f"{SENTENCES['apache2_obtain']} {SENTENCES[f'apache2_url{_end}']}"
    for _part in ("url", "copy"):
        SENTENCES[f"apache2_{_part}{_end}_basis"] = f"{SENTENCES[f'apache2_{_part}{_end}']} {SENTENCES['apache2_basis']}"
_APACHE = [
    run
    for s in ("", "_s")
    for run in (("copy" + s, "basis"), ("obtain", "url" + s, "basis"), ("copy" + s + "_basis",), ("obtain", "url" + s + "_basis"))
]
# Licences and the sentences that make them, in the order in which they are tried.
RULES = (
    *[("Apache-2.0", ("apache2_the", *[f"apache2_{x}" for x in run], "apache2_see")) for run in _APACHE],
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("GPL-3.0-or-later", ("gpl3_free", "gpl_hope", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_see")),
    ("Apache-2.0", ("apache2_short",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_licensed",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache2",)),
    ("GPL-3.0-only", ("spdx_gpl3",)),
    ("BSD-3-Clause", ("spdx_bsd3",)),
)
#: Every known sentence holds one of these, so that other texts need no splitting.
HINT = r"(?i)licen|permi|copyright|redistribut|warrant|as is|rights reserved|liable"
#: Ends of sentences inside a line, and at its end.
STOP = r"[.!?]+[ \t\r]+|[.!?]+$"
#: Paragraph ends: blank lines or lines of comment signs only, and a colon at the end of a line.
PARAGRAPH = r":[ \t\r]*\n+|\n[ \t\r]*([#*/;%-]+[ \t\r]*)?\n+"


def _known(piece: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, text in SENTENCES.items() for x in (text, name)])
    plain = F.btrim(F.regexp_replace(F.lower(piece), "[^a-z0-9]+", " "))
    return F.try_element_at(table, plain)


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in order, as ``<a><b>``; other sentences are left out."""
    found = F.array_compact(F.transform(F.split(text, STOP), _known))
    return F.array_join(F.transform(found, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")


def _step(licence: str, run: str):
    """One rule applied to the struct of licences and rest."""

    def apply(s: Column) -> Column:
        more = F.array_append(s["licences"], F.lit(licence))
        return F.struct(
            F.when(F.contains(s["rest"], F.lit(run)), more).otherwise(s["licences"]).alias("licences"),
            F.replace(s["rest"], F.lit(run), F.lit("|")).alias("rest"),
        )

    return apply


def _matched(sequence: Column) -> Column:
    """Struct of the licences in order of the rules, and the identifiers that no rule used.

    Each rule takes its identifiers out of the sequence, so that a shorter rule
    does not report what a longer one has explained.
    """
    state = F.struct(F.array().cast("array<string>").alias("licences"), sequence.alias("rest"))
    for licence, names in RULES:
        state = let(state, _step(licence, "".join(f"<{n}>" for n in names)))
    return state


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, ``licences`` (sorted, distinct), ``n_sentences`` and ``n_unmatched`` of every row.

    Each text is read twice: line by line, and with line breaks as spaces, so that
    both a bare licence line and a wrapped paragraph are seen; licences of both
    readings count, and the sentence counts are those of the reading with more
    known sentences. Null and empty texts have none. Rows are taken one by one.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"))
    lines = F.regexp_replace("t", "[ \t\r]*\n+", ". ")
    whole = F.regexp_replace(F.regexp_replace("t", PARAGRAPH, ". "), "[ \t\r\n]+", " ")
    read = F.when(F.col("t").rlike(HINT), F.array(_identifiers(lines), _identifiers(whole))).otherwise(F.array(F.lit(""), F.lit("")))

    def result(r: Column) -> Column:
        n = lambda s: (F.length(s) - F.length(F.translate(s, "<", ""))).cast("bigint")
        a, b = F.get(r, 0), F.get(r, 1)

        def of(both: Column) -> Column:
            more = F.when(n(b) > n(a), F.get(both, 1)["rest"]).otherwise(F.get(both, 0)["rest"])
            return F.struct(
                F.array_sort(F.array_distinct(F.concat(F.get(both, 0)["licences"], F.get(both, 1)["licences"]))).alias("licences"),
                F.greatest(n(a), n(b)).alias("n_sentences"),
                n(more).alias("n_unmatched"),
            )

        none = F.struct(F.array().cast("array<string>").alias("licences"), F.lit(0).cast("bigint").alias("n_sentences"), F.lit(0).cast("bigint").alias("n_unmatched"))
        return F.when((a == "") & (b == ""), none).otherwise(let(F.array(_matched(a), _matched(b)), of))

    return rows.select("row", let(read, result).alias("x")).select("row", "x.*")
