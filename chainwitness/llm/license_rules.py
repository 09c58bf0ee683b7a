"""Licences named or quoted in texts: known sentences become identifiers, rules match their order.

A text is cut into sentences, each is normalised and looked up in a table of known licence
sentences. The identifiers that stand in adjacent sentences form sequences, and ordered rules
are matched against them: longer rules come first and take their sentences away from later ones.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and sentence, as licences and notices word it (normalised before use).
SENTENCES = (
    ("apache2_named", "Licensed under the Apache License, Version 2.0."),
    ("apache2_grant", 'Licensed under the Apache License, Version 2.0 (the "License");'
                      " you may not use this file except in compliance with the License."),
    ("apache2_copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2_as_is", "Unless required by applicable law or agreed to in writing, software distributed under the License"
                      ' is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express'
                      " or implied."),
    ("apache2_see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit_named", "Released under the MIT License."),
    ("mit_named", "Licensed under the MIT License."),
    ("mit_named", "This project is licensed under the MIT License."),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
                  ' associated documentation files (the "Software"), to deal in the Software without restriction,'
                  " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
                  " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
                  " subject to the following conditions:"),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial"
                   " portions of the Software."),
    ("as_is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED'
              " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
                  " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
                  " that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
                   " following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
                   " the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                  " promote products derived from this software without specific prior written permission."),
    ("bsd_named", "Licensed under the BSD License."),
    ("gpl3_named", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3_named", "Licensed under the GNU General Public License, version 3."),
    ("gpl2_named", "Licensed under the GNU General Public License, version 2."),
    ("gpl3_grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
                   " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
                   " option) any later version."),
    ("gpl2_grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General"
                   " Public License as published by the Free Software Foundation; either version 2 of the License, or (at your"
                   " option) any later version."),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
                 " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl_see", "See the GNU General Public License for more details."),
    ("lgpl_named", "Licensed under the GNU Lesser General Public License."),
    ("agpl3_named", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl2_form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc_by_named", "Licensed under CC BY 4.0."),
    ("cc_by_sa_named", "Licensed under CC BY-SA 4.0."),
    ("cc_by_nc_named", "Licensed under CC BY-NC 4.0."),
    ("cc_by_nd_named", "Licensed under CC BY-ND 4.0."),
    ("cc0_named", "Released under CC0 1.0."),
    ("cc_by_text", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("public_domain", "This work is in the public domain."),
    ("all_rights", "All rights reserved."),
)

#: Licence and sentence sequence, in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("apache2_grant", "apache2_copy", "apache2_as_is", "apache2_see")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_hope", "gpl_see")),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_hope", "gpl_see")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_grant", "apache2_copy")),
    ("MPL-2.0", ("mpl2_form", "mpl2_copy")),
    ("ISC", ("isc_grant", "as_is")),
    ("Apache-2.0", ("apache2_grant",)),
    ("Apache-2.0", ("apache2_named",)),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_named",)),
    ("ISC", ("isc_grant",)),
    ("BSD", ("bsd_grant",)),
    ("BSD", ("bsd_named",)),
    ("GPL-3.0-or-later", ("gpl3_grant",)),
    ("GPL-2.0-or-later", ("gpl2_grant",)),
    ("GPL-3.0", ("gpl3_named",)),
    ("GPL-2.0", ("gpl2_named",)),
    ("LGPL", ("lgpl_named",)),
    ("AGPL-3.0", ("agpl3_named",)),
    ("MPL-2.0", ("mpl2_form",)),
    ("CC-BY-4.0", ("cc_by_named",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_named",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_named",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_named",)),
    ("CC0-1.0", ("cc0_named",)),
    ("CC-BY-4.0", ("cc_by_text",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("all_rights",)),
)

_ENDS = r"([.!?])\s+"
_OTHER = r"[^\p{L}\p{N}]+"


def _pieces(sentence):
    """A known sentence as texts are cut: at ends of sentences, then normalised."""
    import regex

    cut = regex.sub(_ENDS, "\\1\n", sentence).split("\n")
    return [regex.sub(_OTHER, " ", piece.lower()).strip() for piece in cut]


def _known():
    """Normalised sentence and identifier; a known sentence that is cut itself has numbered identifiers."""
    table = {}
    for name, sentence in SENTENCES:
        pieces = _pieces(sentence)
        for number, piece in enumerate(pieces):
            table[piece] = name if len(pieces) == 1 else f"{name}.{number}"
    return table


def _sequence(names):
    """The identifiers of a rule as they stand in a sequence text."""
    counts = {}
    for name, sentence in SENTENCES:
        counts.setdefault(name, len(_pieces(sentence)))
    parts = [n if counts[n] == 1 else " ".join(f"{n}.{i}" for i in range(counts[n])) for n in names]
    return "".join(f"<{p}>" for part in parts for p in part.split(" "))


#: Marks in texts that are prepared for ``wrapped``: a sentence ends here; one may end here; around a known sentence.
_END, _MAYBE, _FOUND = "\x01", "\x02", "\x03"
_LABEL = r"\(?(?:[0-9]{1,3}|[a-z]|[ivx]{1,4})"


def _folded(sentence):
    """A known sentence as it stands between marks, which are taken for spaces."""
    import regex

    return regex.sub(_OTHER, " ", sentence.lower()).strip()


def _known_pattern():
    """Any known sentence between marks or ends of the text, longest first, its words parted by spaces or line ends."""
    import regex

    parts = {}
    for _, sentence in SENTENCES:
        ends = regex.sub(_ENDS, f"\\1{_END}", sentence.lower())
        words = regex.sub(r"[^\p{L}\p{N}\x01]+", " ", ends).replace(f" {_END}", _END).strip().strip(_END)
        parts[_folded(sentence)] = words.replace(" ", r"[ \x02]").replace(_END, r"[ \x01\x02]")
    return r"(?<![^\x01\x02])(?:" + "|".join(parts[k] for k in sorted(parts, key=lambda k: (-len(k), k))) + r")(?![^\x01\x02])"


def _unwrapped(docs):
    """``left`` of documents with known sentences, in which line ends and list marks part nothing."""
    text = F.regexp_replace(F.lower("_text"), "[\\x01-\\x03]", " ")
    for pattern, mark in (
        (r"\r\n?", "\n"),
        (r"(?:^|(?<=\n))[^\p{L}\p{N}\n]*" + _LABEL + r"\)[ \t]+", ""),  # list marks: 1) (a)
        (r"[.!?]\s+", _END),
        (r"\n[^\p{L}\p{N}]*\n", _FOUND),
        (r":\s+|\n", _MAYBE),
        (r"[^\p{L}\p{N}\x01-\x03]+", " "),
        (r"\x03 ?(?=https? )", _MAYBE),  # an address set apart belongs to its sentence
        (r"\x03", _END),
        (r" ?([\x01\x02]) ?", "$1"),
        (r"(?<![\x01\x02])\x02*\x01[\x01\x02]*", _END),
        (r"\x02+", _MAYBE),
    ):
        text = F.regexp_replace(text, pattern, mark)
    marked = F.regexp_replace(F.trim(text), _known_pattern(), f"{_FOUND}$0{_FOUND}")
    rows = docs.select("_id", "_hash", marked.alias("marked")).where(F.contains("marked", F.lit(_FOUND)))
    pieces = F.split("marked", _FOUND)  # what stands before, a known sentence, what stands between, ...
    folded = F.trim(F.regexp_replace(F.get("_pieces", 2 * F.col("_n") + 1), "[\\x01\\x02]", " "))
    between = F.regexp_replace(F.get("_pieces", 2 * F.col("_n")), r"(?<![^\x01\x02])" + _LABEL + r"(?![^\x01\x02])", "")
    apart = (F.col("_n") > 0) & (F.length(F.translate(between, " \x01\x02", "")) > 0)
    names = F.create_map(*(F.lit(x) for name, sentence in SENTENCES for x in (_folded(sentence), name)))
    found = rows.distinct().withColumn("_pieces", pieces).select(
        "_id", "_hash", "_pieces", F.explode(F.sequence(F.lit(0), F.floor((F.size("_pieces") - 3) / 2).cast("int"))).alias("_n")
    ).select("_id", "_hash", "_n", F.concat(F.when(apart, "<>").otherwise(""), F.lit("<"), names[folded], F.lit(">")).alias("part"))
    return found.groupBy("_id", "_hash").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "part"))), lambda x: x["part"]), "").alias("left")
    )


def scan(docs: DataFrame, wrapped=False) -> DataFrame:
    """Licences found in whole texts: ``_id``, ``_hash``, ``license`` and ``n_found``, how often.

    ``docs`` comes from ``common.identified``. Sentences end at a line feed, or at . ! ? before white
    space, so one wrapped over lines is not known; they are compared in lower case by letters and
    digits alone. A rule matches sentences
    that follow each other directly. Texts without a licence, null and empty ones give no row; rows
    that repeat id and text are one document. Sentences are rows of their own, so long texts
    are no heavy task; only those of the known table, which is small and fixed, are gathered.

    With ``wrapped`` a sentence may go over line ends, with or without comment marks, as licences
    stand in files: blank lines and . ! ? before white space end it, a colon or a line end may.
    Blank lines and list marks (1. 2) (a) *) between sentences do not part them. What is found without it is
    found with it too.
    """
    if wrapped:
        return _matched(_unwrapped(docs), lambda names: "".join(f"<{n}>" for n in names))
    known = docs.sparkSession.createDataFrame(sorted(_known().items()), "sentence string, name string")
    cut = F.split(F.regexp_replace("_text", _ENDS, "$1\n"), "\n")
    sentences = docs.select("_id", "_hash", F.posexplode(cut).alias("place", "sentence")).withColumn(
        "sentence", F.trim(F.regexp_replace(F.lower("sentence"), _OTHER, " "))
    )
    found = sentences.join(F.broadcast(known), "sentence").groupBy("_id", "_hash").agg(
        F.sort_array(F.collect_set(F.struct("place", "name"))).alias("names")
    )
    step = lambda text, x: F.struct(
        F.concat(text["text"], F.when(x["place"] > text["last"] + 1, F.lit("<>")).otherwise(F.lit("")), F.lit("<"), x["name"], F.lit(">")).alias("text"),
        x["place"].alias("last"),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("last"))
    left = F.aggregate("names", start, step)["text"]
    return _matched(found.select("_id", "_hash", left.alias("left")), _sequence)


def _matched(rows, sequence):
    """How often each licence's rules match the sequence text ``left``."""
    counts = {}
    for number, (license_name, names) in enumerate(RULES):
        pattern = sequence(names)
        gone = F.replace(F.col("left"), F.lit(pattern), F.lit("<>"))
        n = ((F.length("left") - F.length(gone)) / (len(pattern) - 2)).cast("int")
        rows = rows.select("_id", "_hash", gone.alias("left"), *counts, n.alias(f"_{number}"))
        counts[f"_{number}"] = license_name
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("license"), F.col(k).alias("n")) for k, v in counts.items())))
    return rows.select("_id", "_hash", each.alias("x")).where("x.n > 0").groupBy("_id", "_hash", F.col("x.license").alias("license")).agg(
        F.sum("x.n").alias("n_found")
    )


def _oracle():
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(_known().items()))
    sql = f"""with known(sentence, name) as (values {known}),
s as (select doc_id, unnest(string_split(regexp_replace(text, '{_ENDS}', '\\1' || chr(10), 'g'), chr(10))) as raw,
             generate_subscripts(string_split(regexp_replace(text, '{_ENDS}', '\\1' || chr(10), 'g'), chr(10)), 1) as place
      from documents),
f as (select doc_id, place, name from (select *, trim(regexp_replace(lower(raw), '{_OTHER}', ' ', 'g')) as sentence from s) join known using (sentence)),
g as (select *, place - coalesce(lag(place) over (partition by doc_id order by place), 0) as gap from f),
r0 as (select doc_id, string_agg(case when gap > 1 then '<>' else '' end || '<' || name || '>', '' order by place) as rest from g group by doc_id)
"""
    parts = []
    for number, (license_name, names) in enumerate(RULES):
        pattern = quoted(_sequence(names))
        sql += f", r{number + 1} as (select doc_id, replace(rest, {pattern}, '<>') as rest from r{number})\n"
        parts.append(f"select a.doc_id, {quoted(license_name)} as license, (length(a.rest) - length(b.rest)) // {len(_sequence(names)) - 2} as n"
                     f" from r{number} a join r{number + 1} b using (doc_id)")
    return sql + "select doc_id, license, sum(n)::bigint as n_found from (" + " union all ".join(parts) + ") where n > 0 group by all"


ORACLE = _oracle()
