"""License scans (operator 10): sentences to identifiers, identifier sequences to licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences in normal form, by identifier.
SENTENCES = {
    "apache2_under": "licensed under the apache license version 2.0",
    "apache2_header": "licensed under the apache license version 2.0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache2_basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_released": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl3_under": "licensed under the gnu general public license version 3",
    "gpl_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "ccby4_work": "this work is licensed under a creative commons attribution 4.0 international license",
    "ccby4_under": "licensed under cc by 4.0",
    "ccbysa4_under": "licensed under cc by sa 4.0",
    "ccbync4_under": "licensed under cc by nc 4.0",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
}
#: Licences by the sentence sequences that state them, other sentences may stand between.
RULES = (
    ("Apache-2.0", ("apache2_under",)),
    ("Apache-2.0", ("apache2_header", "apache2_use", "apache2_basis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("CC-BY-4.0", ("ccby4_work",)),
    ("CC-BY-4.0", ("ccby4_under",)),
    ("CC-BY-NC-4.0", ("ccbync4_under",)),
    ("CC-BY-SA-4.0", ("ccbysa4_under",)),
    ("GPL-2.0-or-later", ("gpl2_redistribute", "gpl_warranty")),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-3.0-only", ("gpl3_under",)),
    ("GPL-3.0-or-later", ("gpl_redistribute", "gpl_warranty")),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_released",)),
    ("MIT", ("mit_under",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_warranty")),
    ("MPL-2.0", ("mpl2_form",)),
    ("Unlicense", ("unlicense_free",)),
)
#: A rule is not reported where a rule listed beside it here holds, as its sentences are among that rule's.
SUPERSEDED = {"BSD-2-Clause": "BSD-3-Clause"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of these is in every known sentence, also where a line break or a comment mark parts the words.
HINT = "licen[sc]e|licensed|permission|redistribut|public[^a-z0-9]+domain|without[^a-z0-9]+(any[^a-z0-9]+)?warranty"
#: The two readings of the SQL.
LINE_SPLIT, TEXT_SPLIT = "[.!?:;]+[ \\t\\r]+|\\n+", "[.!?:;]+[ \\t\\r\\n]+"
_NORMAL = {k: " ".join(w.strip(".") for w in v.split()) for k, v in SENTENCES.items()}
#: A known sentence from one border (L) to another, its words parted by spaces or borders; a shorter one first.
_ANY = "(?<=L)(" + "|".join(v.replace(".", "[.]").replace(" ", "[ L]") for v in sorted(_NORMAL.values(), key=lambda v: (len(v), v))) + ")(?=L)"


def _known(low: Column) -> Column:
    """Identifiers of the known sentences of a text in lower case, in order; L marks a border, as no capital is left."""
    out = F.concat(F.lit("L"), low, F.lit("\n"))
    for pattern, by in (("[.!?:;]+[ \\t\\r\\n]+|\\n+", "L"), ("[^a-z0-9.L]+", " "), ("(?<=[ L])[.]+|[.]+(?=[ L])", ""), (" *L[ L]*", "L"), (" +", " ")):
        out = F.regexp_replace(out, pattern, by)
    table = F.create_map(*(F.lit(x) for k, v in _NORMAL.items() for x in (v, k)))
    return F.transform(F.regexp_extract_all(out, F.lit(_ANY), 1), lambda s: F.element_at(table, F.translate(s, "L", " ")))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (joined by a comma, in text order), n_sentences and licenses (joined by a comma, by name).

    Sentence ends, colons, semicolons and line breaks are borders. A known sentence is found from any border to any
    later one, whatever borders lie within it: wrapped, under a title line or behind comment marks. Sentences do not
    overlap; of two from the same border the shorter is taken. A licence is found if one of its rules' identifiers
    stand in this order. Null texts and texts without known sentences have empty strings and 0.
    Rows are independent and unmoved; repeated rows and null ids give a row each, other columns are ignored.
    """
    hinted = docs.select("doc_id", F.translate("text", _UPPER, _LOWER).alias("_low"))
    ids = hinted.select("doc_id", F.coalesce(F.when(F.col("_low").rlike(HINT), _known(F.col("_low"))), F.array().cast("array<string>")).alias("_ids"))
    seq = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    matches = ids.withColumn("_seq", seq)
    names = sorted({n for n, _ in RULES})
    held = {n: F.lit(False) for n in names}
    for name, parts in RULES:
        held[name] = held[name] | F.col("_seq").rlike("".join((".*" if i else "") + f",{p}(?=,)" for i, p in enumerate(parts)))
    shown = {n: held[n] & ~held[SUPERSEDED[n]] if n in SUPERSEDED else held[n] for n in names}
    licenses = F.array_join(F.array_compact(F.array(*(F.when(shown[n], F.lit(n)) for n in names))), ",")
    return matches.select("doc_id", F.array_join("_ids", ",").alias("sentence_ids"), F.size("_ids").cast("long").alias("n_sentences"), licenses.alias("licenses"))


def _sql() -> str:
    """Unnested sentences joined with the table, and rules by positions; only sentences that one of two splits yields whole."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(v)}, {quote(k)})" for k, v in SENTENCES.items())

    def reading(name: str, split_at: str) -> str:
        return f"""{name} AS (
  SELECT doc_id, list(id ORDER BY pos) AS ids FROM (
    SELECT doc_id, k.id, pos FROM (
      SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split_regex(low, '{split_at}') AS s FROM low)
    ) JOIN known k ON k.sentence = trim(regexp_replace(regexp_replace(raw, '[^a-z0-9.]+', ' ', 'g'), '(^| )[.]+|[.]+( |$)', ' ', 'g'))
  ) GROUP BY doc_id)"""

    rules = []
    for name in sorted({n for n, _ in RULES}):
        held = lambda n: "(" + " OR ".join(f"regexp_matches(seq, {quote(''.join(('.*' if i else '') + ',' + p + ',' if i == len(parts) - 1 else ('.*' if i else '') + ',' + p for i, p in enumerate(parts)))})" for m, parts in RULES if m == n) + ")"
        cond = held(name) + (f" AND NOT {held(SUPERSEDED[name])}" if name in SUPERSEDED else "")
        rules.append(f"CASE WHEN {cond} THEN {quote(name)} END")
    return f"""WITH known(sentence, id) AS (VALUES {known}),
low AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents),
{reading('a', LINE_SPLIT)},
{reading('b', TEXT_SPLIT)},
c AS (SELECT d.doc_id, CASE WHEN coalesce(len(b.ids), 0) > coalesce(len(a.ids), 0) THEN b.ids ELSE coalesce(a.ids, []) END AS ids FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
e AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS seq FROM c)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences,
  array_to_string(list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL), ',') AS licenses FROM e"""


ORACLE = _sql()
