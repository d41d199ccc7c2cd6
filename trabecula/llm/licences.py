"""Licence recognition by sentence rules, with DataFrame functions only.

Texts are cut into sentences, each is normalised and looked up among known licence sentences. The identifiers found, in order, are matched
against ordered rules: a licence is reported where the identifiers of its rule follow each other, other licence sentences apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import table

#: Normalised whole sentences as `sentences` cuts them, by identifier, and GPL sentences before the cut. Fixed values; `#` stands for a version number.
SENTENCES = {
    "ApacheRef": "licensed under the apache license version #",
    "ApacheHeader": "licensed under the apache license version # the license",
    "ApacheMayNot": "you may not use this file except in compliance with the license",
    "ApacheCopyAt": "you may obtain a copy of the license at",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "MitRef": "released under the mit license",
    "MitTitle": "the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AsIsShort": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "GplRef": "this work is licensed under the gnu general public license version #",
    "GplRedistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version",
    "GplNoWarranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplModify": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version # of the license or at your option any later version",
    "GplTerms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "GplLater": "either version # of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty",
    "GplEven": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "CcByNcRef": "licensed under cc by nc #",
    "CcByRef": "licensed under cc by #",
    "CcBySaRef": "licensed under cc by sa #",
    "BsdRedistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "AllRights": "all rights reserved",
}
#: Licences by the identifiers that must follow each other; longer rules of a family come first and use their sentences up. Fixed values.
RULES = [
    ("Apache", ["ApacheRef", "ApacheMayNot", "ApacheCopyAt", "ApacheAsIs"]),
    ("Apache", ["ApacheHeader", "ApacheMayNot", "ApacheCopyAt", "ApacheAsIs"]),
    ("Apache", ["ApacheRef"]),
    ("Apache", ["ApacheHeader"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIsShort"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["MitTitle"]),
    ("GPL-or-later", ["GplRedistribute", "GplNoWarranty"]),
    ("GPL-or-later", ["GplModify", "GplHope", "GplEven"]),
    ("GPL-or-later", ["GplTerms", "GplLater", "GplHope", "GplEven"]),
    ("GPL", ["GplRef"]),
    ("CC-BY-NC", ["CcByNcRef"]),
    ("CC-BY-SA", ["CcBySaRef"]),
    ("CC-BY", ["CcByRef"]),
    ("BSD-3-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary"]),
]
#: Every known sentence has one of these; a sentence with one that isn't known is an unknown licence sentence. Fixed values.
GOOD_WORDS = ["licen[cs]e", "licensed", "copyright", "permission", "redistribut", "warrant", "rights reserved", "without restriction", "public domain"]
VERSION = r"[0-9]+(?:\.[0-9]+)*"
#: Two-stage cut that regular expression engines share: mark the ends, then split at the marks.
BREAK = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences: they end at . ! ? ; : before white space, at blank lines, and where a line begins with a capital and a small letter."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?;:])\s+", f"$1{BREAK}"), r"\n\s*\n", BREAK)
    return F.split(F.regexp_replace(marked, r"\n([A-Z][a-z])", f"{BREAK}$1"), F.lit(BREAK), -1)


def normalise(sentence: Column) -> Column:
    """Lower-case words and version signs, one space between: numbers with dots become `#`, other signs go."""
    numbers = F.regexp_replace(F.lower(sentence), VERSION, "#")
    return F.trim(F.regexp_replace(numbers, "[^a-z#]+", " "))


def match_rules(ids: Column) -> Column:
    """Licences of the sequence of (id, version): a rule is found at each place where its identifiers follow each other, and uses them up."""
    left = F.concat(F.lit(" "), F.array_join(F.transform(ids, lambda x: x["id"]), "  "), F.lit(" "))
    found = []
    for name, rule in RULES:
        pattern = "".join(f" {x} " for x in rule)
        found.append(F.when(F.contains(left, F.lit(pattern)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
        left = F.replace(left, F.lit(pattern), F.lit(" - "))
    return F.array_distinct(F.concat(*found))


def scan_licences(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, licences (in order of the rules), sentence_ids (in order of the text, with version), n_known, n_unknown.

    Null and empty texts have none. Texts without any of the good words can't hold a known sentence and are not cut. `n_unknown` counts sentences with a
    good word that are not known. Repeated rows are scanned alike; an empty table gives an empty result; other columns are not read.
    """
    good = "|".join(GOOD_WORDS)
    whole = F.coalesce(F.col(text), F.lit(""))
    worth = F.filter(sentences(whole), lambda s: F.lower(s).rlike(good))
    cut = F.when(F.lower(whole).rlike(good), F.transform(worth, lambda s: F.struct(normalise(s).alias("norm"), F.regexp_extract(s, VERSION, 0).alias("version")))).otherwise(F.array().cast("array<struct<norm:string,version:string>>"))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    rows = docs.select(*keys, cut.alias("__s"))
    rows = rows.select(*keys, F.transform("__s", lambda s: F.struct(F.try_element_at(known, s["norm"]).alias("id"), s["version"].alias("version"))).alias("__s"))
    rows = rows.select(*keys, F.filter("__s", lambda s: s["id"].isNotNull()).alias("__ids"), F.size("__s").alias("__n"))
    return rows.select(*keys, match_rules(F.col("__ids")).alias("licences"), F.col("__ids").alias("sentence_ids"), F.size("__ids").alias("n_known"), (F.col("__n") - F.size("__ids")).alias("n_unknown"))


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join(F.transform("sentence_ids", lambda s: F.concat_ws(" ", s["id"], F.nullif(s["version"], F.lit("")))), ",").alias("sentence_ids"),
                        F.col("n_known").cast("long").alias("n_known"), F.col("n_unknown").cast("long").alias("n_unknown"))


def _sql() -> str:
    good = "|".join(GOOD_WORDS)
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    steps, columns, last = [], [], "start"
    for k, (name, rule) in enumerate(RULES):
        pattern = "".join(f" {x} " for x in rule)
        steps.append(f"r{k} AS (SELECT *, contains(rest{k}, '{pattern}') AS f{k}, replace(rest{k}, '{pattern}', ' - ') AS rest{k + 1} FROM {last})")
        columns.append(f"CASE WHEN f{k} THEN '{name}' END")
        last = f"r{k}"
    names = list(dict.fromkeys(n for n, _ in RULES))
    ordered = ", ".join(f"CASE WHEN {' OR '.join(f'f{k}' for k, (m, _) in enumerate(RULES) if m == n)} THEN '{n}' END" for n in names)
    return f"""
WITH known(norm, id) AS (VALUES {known}),
cuts AS (
  SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])\\s+', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g'),
                                               '\\n([A-Z][a-z])', chr(1) || '\\1', 'g'), chr(1)) AS s FROM documents)),
worth AS (
  SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(s), '{VERSION}', '#', 'g'), '[^a-z#]+', ' ', 'g')) AS norm, regexp_extract(s, '{VERSION}', 0) AS version
  FROM cuts WHERE regexp_matches(lower(s), '{good}')),
per AS (
  SELECT doc_id, string_agg(id, '  ' ORDER BY pos) AS ids, string_agg(id || CASE WHEN version = '' THEN '' ELSE ' ' || version END, ',' ORDER BY pos) AS sentence_ids,
         count(id) AS n_known, count(*) - count(id) AS n_unknown FROM worth LEFT JOIN known USING (norm) GROUP BY doc_id),
start AS (
  SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown, ' ' || coalesce(ids, '') || ' ' AS rest0
  FROM documents d LEFT JOIN per USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, concat_ws(',', {ordered}) AS licences, sentence_ids, n_known, n_unknown FROM {last}"""


OP8_SQL = _sql()
