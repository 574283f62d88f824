"""Canonical digest lookup of licence texts, in native columns only."""

from __future__ import annotations

import hashlib
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that name a year or an owner, which differ between copies of one licence: "copyright" (or its signs) before a
#: year, a sign or a placeholder, or "all rights reserved" alone. A line of the terms that a wrap makes begin with
#: "copyright" has none of these and stays.
COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*((copyright[^a-z0-9\n]*|\(c\)[^a-z0-9\n]*|©[^a-z0-9\n]*)(\(c\)|©|by |[12][0-9]{3}|[\[<{(](year|yyyy|date|owner|name))[^\n]*"
    r"|©[^\n]*|all rights reserved[^a-z0-9\n]*)$"
)
#: Spellings that mean the same, on lower-case words parted by one space.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("favour", "favor"),
    ("https", "http"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
#: Known licence texts and statements by SPDX identifier. Fixed values.
KNOWN: list[tuple[str, str]] = [
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.\n\n" + _NO_WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _ISC_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from "
        "any source distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, one space between words, one spelling of each word."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old}"), F.lit(f" {new}"))
    return F.trim(x)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; that of the empty text where nothing is left of it."""
    return F.sha2(canonical(text), 256)


#: The digest of nothing, which matches no licence.
EMPTY = hashlib.sha256(b"").hexdigest()


def full_texts() -> list[tuple[str, str]]:
    """Canonical texts of common licences (the files of licence_texts, by identifier), with and without their appendix."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text(encoding="utf-8")
        terms, end, _ = text.rpartition("END OF TERMS AND CONDITIONS")
        out += [(file.name.removesuffix(".txt"), x) for x in ([text, terms + end, terms] if end else [text])]
    return out


def known_digests(spark, known=None) -> DataFrame:
    """(license_id, digest) of the known texts, by default KNOWN and the full texts; one row for each digest."""
    known = KNOWN + full_texts() if known is None else known
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.select("license_id", digest(F.col("text")).alias("digest")).where(F.col("digest") != EMPTY).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_matches(docs: DataFrame, known: DataFrame, most_known: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each whole document, and each whole line of one, that is a known licence: id, scope, line_no, license_id, digest.

    line_no is -1 for a document and counts lines from 0 otherwise. Null and empty texts match nothing; repeated rows
    match each by itself; other columns are not read. The known table is broadcast while it has at most ``most_known``
    rows (a digest and a name each) and shuffled beyond that.
    """
    # digests are made inside the array, before it is exploded, so that each is computed once
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.cast("int").alias("line_no"), digest(x).alias("digest")))
    whole = F.array(F.struct(F.lit(-1).alias("line_no"), digest(F.col("text")).alias("digest")))
    units = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    units = units.select("id", F.explode(F.concat(whole, lines)).alias("x")).select("id", "x.*")
    if known.limit(most_known + 1).count() <= most_known:
        known = F.broadcast(known)
    found = units.join(known, "digest")
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("line_no") < 0, "document").otherwise("line").alias("scope"), "line_no", "license_id", "digest"
    )


def op7_license_digests(spark, sf_dir: str) -> DataFrame:
    """Whole documents, and whole lines of documents, that are known licence texts."""
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def _sql_canonical(x: str) -> str:
    x = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
    x = f"(' ' || trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    for old, new in SPELLINGS:
        x = f"replace({x}, ' {old}', ' {new}')"
    return f"trim({x})"


def sql() -> str:
    """The same list of texts, short and full, made canonical by DuckDB."""
    values = ", ".join("('%s', '%s')" % (k, t.replace("'", "''")) for k, t in KNOWN + full_texts())
    return f"""
    with known as (select digest, min(license_id) as license_id from (
        select license_id, sha256({_sql_canonical("t")}) as digest from (values {values}) v(license_id, t)) group by digest),
    units as (
        select doc_id, -1 as line_no, text as unit from documents where text is not null
        union all
        select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::int, unnest(string_split(text, chr(10)))
        from documents where text is not null),
    dug as (select doc_id, line_no::int as line_no, {_sql_canonical("unit")} as c from units)
    select doc_id, case when line_no < 0 then 'document' else 'line' end as scope, line_no, license_id, digest
    from (select *, sha256(c) as digest from dug where c <> '') join known using (digest)
    """
