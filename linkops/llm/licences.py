"""Licence recognition: sentences to known identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, render

# The wording of public licences and of common one-line notices, one sentence per identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-copies": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
}
# Licence, whether training on it needs care, and the identifiers that must follow one another.
RULES = (
    ("mit", "permissive", ("mit-notice",)),
    ("mit", "permissive", ("mit-notice-2",)),
    ("mit", "permissive", ("mit-grant", "mit-copies", "mit-warranty")),
    ("apache-2.0", "permissive", ("apache-notice",)),
    ("apache-2.0", "permissive", ("apache-notice-2", "apache-copy", "apache-basis")),
    ("gpl-3.0", "copyleft", ("gpl3-notice",)),
    ("gpl-3.0", "copyleft", ("gpl3-free", "gpl-hope")),
    ("cc-by-nc-4.0", "noncommercial", ("ccbync-notice",)),
    ("cc-by-nc-4.0", "noncommercial", ("ccbync-work",)),
    ("bsd", "permissive", ("bsd-grant", "bsd-warranty")),
)

# A sentence ends after . ! or ? before a blank, and at a line end unless the next line goes on in lower case.
_ENDS = r"([.!?])[ \t\r\n]+"
_LINES = r"\n([ \t\r]*[^a-z \t\r])"
_REST = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_CUT = "\x1e"
# Wrapped texts: only . ! ? and lines without words end a sentence for certain; a colon and other line ends may end it.
_COLON = r":[ \t\r\n]+"
_BLANK = r"\n[^A-Za-z0-9\x{80}-\x{10FFFF}\n\x1e]*(?=\n)"
_GAPS = r"[^a-z0-9\x{80}-\x{10FFFF}\x1e\x1f]+"
_MAYBE = "\x1f"


def normalised(sentence: Column) -> Column:
    """Lower-case words of an already lower-cased sentence with single blanks between."""
    return F.trim(F.regexp_replace(sentence, _REST, " "))


def _normal(text: str) -> str:
    import re

    return re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def _wrapped(whole: Column, known: dict[str, str]) -> Column:
    """Known sentences in order, each a run of whole lines, whatever their ends and comment marks; the longest counts."""
    text = F.regexp_replace(F.regexp_replace(whole, _ENDS, f"$1{_CUT}"), _BLANK, _CUT)
    text = F.regexp_replace(F.regexp_replace(text, _LINES, f"{_MAYBE}$1"), _COLON, _MAYBE)
    text = F.concat(F.lit(_CUT), F.regexp_replace(ascii_lower(text), _GAPS, " "), F.lit(_CUT))
    any_of = "|".join(k.replace(" ", r"[ \x1f]+") for k in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"[\x1e\x1f] ?({any_of})(?= ?[\x1e\x1f])"), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, r"[ \x1f]+", " "))


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """``docs`` with ``n_sentences``, ``sentence_ids`` (known sentences in order) and ``licences`` (sorted names of
    the rules whose identifiers follow one another in that sequence; unknown sentences between them do not matter).
    Sentences are looked for with and without their line cuts, so texts in any wrapping and in comments count;
    ``n_sentences`` counts with the cuts.

    All work is on the row itself, so nothing is shuffled and any key, repeated or null, keeps its rows. The known
    sentences are a hash set in the plan; they are part of the rules, not of the data. Null or empty texts have no
    sentences; columns named like the three outputs are replaced.
    """
    known = {_normal(v): k for k, v in (sentences or SENTENCES).items()}
    whole = F.coalesce(F.col(text), F.lit(""))
    # Cut in the original case, which tells where lines go on, then lower.
    cut = F.regexp_replace(F.regexp_replace(whole, _ENDS, f"$1{_CUT}"), _LINES, f"{_CUT}$1")
    parts = F.filter(F.split(ascii_lower(cut), _CUT), lambda s: F.trim(s) != "")
    words = F.filter(F.transform(parts, normalised), lambda s: s.isin(list(known)))
    to_id = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    base = docs.drop("n_sentences", "sentence_ids", "licences")
    (lines,) = fresh(base, "_line_ids")

    def found(ids: str) -> list[Column]:
        sequence = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
        return [F.when(F.contains(sequence, F.lit(f",{','.join(own)},")), F.lit(name)) for name, _, own in rules]

    return (
        base.withColumns({
            "n_sentences": F.size(parts).cast("long"), lines: F.transform(words, lambda s: to_id[s]),
            "sentence_ids": F.transform(_wrapped(whole, known), lambda s: to_id[s]),
        })
        .withColumn("licences", F.array_sort(F.array_distinct(F.array_compact(F.array(*found(lines), *found("sentence_ids"))))))
        .drop(lines)
    )


def sql() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    ids = ", ".join(f"({quote(_normal(v))}, {quote(k)})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({quote(name)}, {quote(',' + ','.join(s) + ',')})" for name, _, s in RULES)
    return render(r"""
WITH known(sentence, id) AS (VALUES {ids}), rules(licence, seq) AS (VALUES {rules}),
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r\n]+', '\1' || chr(30), 'g'),
  '\n([ \t\r]*[^a-z \t\r])', chr(30) || '\1', 'g'), chr(30)), lambda s: trim(s, ' ') <> '') AS parts FROM documents),
pos AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM cut),
hit AS (SELECT doc_id, string_agg(id, ',' ORDER BY i) AS sentence_ids, count(*) AS n_known FROM pos JOIN known
  ON sentence = trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') GROUP BY 1),
lic AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hit JOIN rules ON contains(',' || sentence_ids || ',', seq) GROUP BY 1)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM cut LEFT JOIN hit USING (doc_id) LEFT JOIN lic USING (doc_id)""", ids=ids, rules=rules)
