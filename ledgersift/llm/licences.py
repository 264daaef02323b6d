"""Licence scan by canonical digests.

Texts and lines are brought into one canonical form (case, punctuation,
copyright lines, equivalent spellings) and looked up by digest among known
licences: the whole text against whole licences, each line against notices.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "copyrighted": "copyright",
    "sub license": "sublicense", "non commercial": "noncommercial", "per cent": "percent",
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "centre": "center", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful",
}

#: Short notices and licence texts by identifier.
KNOWN = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        " SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY"
        " SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
        " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0."],
}

#: Whole texts and headers, in files named after the licence and, parted by "~", the variant.
TEXTS = Path(__file__).resolve().parent / "licence_texts"
#: What may stand above a whole text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
}
TERMS_END = "END OF TERMS AND CONDITIONS"
WHOLE_CHARS = 400

MAX_KNOWN = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where a line goes on after its copyright statement.
GOES_ON = (
    r"\b(?:permission (?:is|to)|licen[cs]ed under|released under|redistribution and use|everyone is permitted"
    r"|this (?:work|program|library|software|file|source code)) "
)
COPYRIGHT = (
    rf"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)(?=[^a-z\n]|$)(?:(?!{GOES_ON})[^\n])*+"
    r"|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
GAPS = r"[^a-z0-9\x80-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), no copyright lines, words parted by single blanks, one spelling."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, " ")
    return spelled(F.trim(F.regexp_replace(plain, GAPS, " ")))


def spelled(text: Column) -> Column:
    """One spelling for the words in :data:`SPELLINGS`; text as :func:`canonical` parts it.

    The replacements run only where one of the words occurs. Blanks are doubled
    for the while, so that neighbouring words do not share one.
    """
    padded = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        padded = F.replace(padded, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    hint = "(?:^| )(?:" + "|".join(SPELLINGS) + ")(?: |$)"
    return F.when(text.rlike(hint), F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))).otherwise(text)


def known_texts() -> dict[str, list[str]]:
    """:data:`KNOWN` and the files of :data:`TEXTS`; whole texts also under a title and without what follows the terms."""
    known = {n: list(texts) for n, texts in KNOWN.items()}
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, rest = text.partition(TERMS_END)
        forms = [text] + [terms + end, terms] * bool(rest)
        if file.stem.startswith("BSD"):  # conditions come with bullets or numbers
            number = itertools.count(1)
            forms += [re.sub(r"(?m)^\s*(?:\*|\d\.) ", lambda _: f"{next(number)}. ", text),
                      re.sub(r"(?m)^\s*(?:\*|\d\.) ", "", text)]
        known.setdefault(file.stem.split("~")[0], []).extend(forms)
    return {
        n: texts + [f"{title}\n{t}" for t in texts if len(t) > WHOLE_CHARS for title in TITLES.get(n, [])]
        for n, texts in known.items()
    }


def known_licences(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(licence, digest, size) of the known texts (default: :func:`known_texts`), one row per distinct canonical text."""
    known = known_texts() if known is None else known
    rows = F.array(
        *[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, texts in known.items() for t in texts]
    )
    form = spark.range(1).select(F.explode(rows).alias("x")).select(
        "x.licence", canonical(F.col("x.text")).alias("form")
    )
    return form.groupBy(F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).agg(
        F.min("licence").alias("licence")
    )


def scan_licences(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Add ``text_digest``, ``licence`` (of the whole text, or null) and ``notices`` (of its lines).

    ``known`` is a small table of (digest, size, licence), at most ``MAX_KNOWN``
    rows: broadcast for the whole texts, and literals for the lines, of which
    only those with a known size get a digest. Null texts count as empty and
    match nothing. Rows are neither merged nor dropped; columns of these names
    are replaced. ``notices`` is a sorted list without repeats.
    """
    table = known.where(F.col("size") > 0).orderBy("digest").limit(MAX_KNOWN + 1).collect()
    if len(table) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts")
    sizes = sorted({r["size"] for r in table})
    source = F.coalesce(F.col(text), F.lit(""))
    names = docs.drop("text_digest", "licence", "notices")
    if not sizes:
        return names.withColumns({
            "text_digest": F.sha2(canonical(source), 256), "licence": F.lit(None).cast("string"),
            "notices": F.array().cast("array<string>"),
        })
    lines = F.transform(
        F.split(F.translate(source, UPPER, LOWER), "\n"),
        lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, COPYRIGHT, " "), GAPS, " ")),
    )
    # No spelling shortens a line by half; longer lines cannot match.
    near = F.transform(F.filter(lines, lambda x: (x != "") & (F.length(x) <= 2 * sizes[-1])), spelled)
    digests = F.transform(F.filter(near, lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256))
    by_digest = F.map_from_arrays(
        F.array(*[F.lit(r["digest"]) for r in table]), F.array(*[F.lit(r["licence"]) for r in table])
    )
    found = F.transform(digests, lambda d: F.try_element_at(by_digest, d))
    whole = F.broadcast(known.where(F.col("size") > 0).select(F.col("digest").alias("text_digest"), "licence"))
    return (
        names.withColumn("text_digest", F.sha2(canonical(source), 256))
        .withColumn("notices", F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))))
        .join(whole, "text_digest", "left")
    )
