"""Licence scans: passages compared with licence notices by Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm.common import take

THRESHOLD = 0.8
# Most templates, and most bigrams of one: the bound of the table that is broadcast.
MAX_TEMPLATES = 1_000
MAX_TEMPLATE_BIGRAMS = 200

# Usual short notices, by the identifier of the licence they name.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Everything but letters, digits and line feeds separates words.
SEPARATORS = r"[^\p{L}\p{N}\n]+"


def _words_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), SEPARATORS, " ")


def _bigrams(passage: Column) -> Column:
    """Pairs of neighbouring words, repeats included."""
    words = F.split(passage, " ")
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _spaces(passage: Column) -> Column:
    """Number of bigrams of a passage whose words have one space between them."""
    return F.length(passage) - F.length(F.replace(passage, F.lit(" "), F.lit("")))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """``license_id``, ``size`` (bigrams), ``bigram``, ``times``, for templates of two words or more."""
    given = TEMPLATES if templates is None else templates
    if len(given) > MAX_TEMPLATES or any(len(t.split()) > MAX_TEMPLATE_BIGRAMS for t in given.values()):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of {MAX_TEMPLATE_BIGRAMS} words")
    rows = spark.createDataFrame(list(given.items()), "license_id string, notice string")
    passages = rows.select("license_id", F.trim(F.replace(_words_only(F.col("notice")), F.lit("\n"), F.lit(" "))).alias("passage"))
    grams = passages.select("license_id", _spaces(F.col("passage")).alias("size"), F.explode(_bigrams(F.col("passage"))).alias("bigram"))
    return grams.groupBy("license_id", "size", "bigram").agg(F.count(F.lit(1)).alias("times"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Passages of ``docs`` (``doc_id``, ``text``) that are like a licence notice.

    A passage is a line of a text, or the whole text (``line`` -1) where it has several lines, as
    words in lower case. Dice is twice the shared bigrams over the bigrams of both, repeats included.
    A passage of n bigrams can reach the threshold t only with a template of t/(2-t) n to (2-t)/t n
    of them, so passages outside the bounds of all templates are dropped before they are cut into
    bigrams, and a passage meets only templates inside its bounds. Bigrams that no template has
    are dropped by a join with the broadcast index of all templates, at most MAX_TEMPLATES times
    MAX_TEMPLATE_BIGRAMS rows; only what is left is grouped.

    Result: ``doc_id``, ``line`` (from 0), ``license_id``, ``shared``, ``dice``, for all templates that
    reach the threshold. Null and empty texts have no passage, repeated rows are scanned each, and a
    text without match has no row; no templates match nothing. Other columns are ignored.
    """
    index = template_table(docs.sparkSession, templates)
    least, most = index.agg(F.min("size"), F.max("size")).first()  # one row over a bounded table
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    rows = take(docs, "doc_id", "text").select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), _words_only(F.col("text")).alias("norm")
    )
    lines = F.split("norm", "\n")
    whole = F.when(F.contains("norm", F.lit("\n")), F.array(F.replace("norm", F.lit("\n"), F.lit(" "))))
    none = F.array().cast("array<string>")
    passages = rows.select(
        "doc_id", "row_id", F.size(lines).alias("count"),
        F.posexplode(F.concat(lines, F.coalesce(whole, none))).alias("at", "raw"),
    ).select(
        "doc_id", "row_id", F.when(F.col("at") == F.col("count"), -1).otherwise(F.col("at")).alias("line"),
        F.trim(F.regexp_replace("raw", " +", " ")).alias("passage"),
    )
    sized = passages.withColumn("n", _spaces(F.col("passage"))).where(
        F.col("n").between(low * (least or 0), high * (most or -1)) & (F.col("n") > 0)
    )
    grams = sized.select("doc_id", "row_id", "line", "n", F.explode(_bigrams(F.col("passage"))).alias("bigram"))
    fits = (F.col("n") >= low * F.col("size")) & (F.col("n") <= high * F.col("size"))
    hits = grams.join(F.broadcast(index), "bigram").where(fits)
    key = ["row_id", "doc_id", "line", "license_id", "n", "size"]
    shared = (
        hits.groupBy(*key, "bigram", "times").agg(F.count(F.lit(1)).alias("here"))
        .groupBy(*key).agg(F.sum(F.least("here", "times")).alias("shared"))
    )
    return (
        shared.withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("size")))
        .where(F.col("dice") >= threshold)
        .select("doc_id", "line", "license_id", "shared", "dice")
    )


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL over ``documents``."""
    given = TEMPLATES if templates is None else templates
    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in given.items())
    norm = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
    WITH notices(license_id, notice) AS (VALUES {values}),
    nw AS (SELECT license_id, string_split(trim({norm.format('notice')}), ' ') AS w FROM notices),
    ng AS (SELECT license_id, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM nw),
    ix AS (SELECT license_id, size, bigram, count(*) AS times FROM ng GROUP BY ALL),
    d AS (SELECT doc_id, row_number() OVER () AS row_id, {norm.format('text')} AS norm FROM documents),
    ps AS (
      SELECT doc_id, row_id, unnest(range(len(string_split(norm, chr(10))))) AS line, unnest(string_split(norm, chr(10))) AS raw FROM d
      UNION ALL
      SELECT doc_id, row_id, -1 AS line, replace(norm, chr(10), ' ') AS raw FROM d WHERE contains(norm, chr(10))),
    pw AS (SELECT doc_id, row_id, line, string_split(trim(regexp_replace(raw, ' +', ' ', 'g')), ' ') AS w FROM ps),
    pn AS (SELECT doc_id, row_id, line, w, len(w) - 1 AS n FROM pw
           WHERE len(w) - 1 BETWEEN {low!r} * (SELECT min(size) FROM ix) AND {high!r} * (SELECT max(size) FROM ix)),
    pg AS (SELECT doc_id, row_id, line, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM pn),
    pc AS (SELECT doc_id, row_id, line, n, bigram, count(*) AS here FROM pg GROUP BY ALL),
    s AS (SELECT row_id, doc_id, line, license_id, n, size, CAST(sum(least(here, times)) AS BIGINT) AS shared
          FROM pc JOIN ix USING (bigram) WHERE n >= {low!r} * size AND n <= {high!r} * size GROUP BY ALL)
    SELECT doc_id, CAST(line AS INTEGER) AS line, license_id, shared, 2.0::DOUBLE * shared / (n + size) AS dice
    FROM s WHERE 2.0::DOUBLE * shared / (n + size) >= {threshold!r}
    """
