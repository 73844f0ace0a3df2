"""Street search queries over streets and query strings derived from the inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import vocab
from geoweave.operators import suggest as G
from geoweave.operators.aggregates import (
    city_centroids, civic_units, stale_provinces, street_ranges, street_search_rows,
)
from geoweave.plans import oracle_parts as O
from geoweave.plans.geocode_queries import store
from geoweave.plans.registry import places, query
from geoweave.session import cut_lineage, scratch_path
from geoweave.sources import derived
from geoweave.sources.addresses import index_streets, street_index
from geoweave.sources.store import snapshot

_SQ = derived.SEARCH_QUERIES_SQL.format(addr="addr_raw")
_TYPE_OF = O.case_map("w", vocab.STREET_TYPE_CANONICAL, "w")
_DIR_OF = O.case_map("w", vocab.STREET_DIRECTION, "w")


def _spaced(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[/-]', ' ', 'g'), ' +', ' ', 'g'))"


_SEARCH = f"""
WITH {O.ADDR}, {O.CITY}, {O.STREET},
docs AS (
  SELECT s.*, c.city, s.city_key || chr(9) || s.street_key AS doc_id,
    replace(s.street_key, '|', ' ') || ' ' || split_part(s.city_key, '|', 1) || ' ' || s.province AS suggest_text
  FROM street_c s JOIN city_c c USING (province, city_key)),
doc AS (SELECT *, ' ' || {_spaced('suggest_text')} AS padded, len(string_split({_spaced('suggest_text')}, ' ')) AS n_words FROM docs),
size AS (SELECT count(*) AS n, avg(n_words) AS avg_words FROM doc),
sq AS ({_SQ}),
{O.parse_ctes('sq', 'q', 'query_id', 'sp')},
prep0 AS (
  SELECT sq.*, {O.tok('q')} AS normalized, TRY_CAST(nullif(regexp_extract(sp.civic, '^[0-9]+'), '') AS BIGINT) AS civic,
    {O.tok("regexp_replace(sp.unit, '^#', '')")} AS unit
  FROM sq JOIN sp USING (query_id)),
prep AS (
  SELECT *, CASE WHEN civic IS NOT NULL AND contains(normalized, ' ') AND regexp_matches(split_part(normalized, ' ', 1), '[0-9]')
    THEN substr(normalized, strpos(normalized, ' ') + 1) ELSE normalized END AS search_text
  FROM prep0 WHERE length(normalized) >= 3 AND NOT (bias_lat IS NOT NULL AND box_min_lat IS NOT NULL)),
texts AS (SELECT DISTINCT search_text FROM prep),
words AS (
  SELECT search_text, g, w FROM (SELECT search_text, unnest(string_split(search_text, ' ')) AS w,
    generate_subscripts(string_split(search_text, ' '), 1) AS g FROM texts) WHERE w <> ''),
forms AS (
  SELECT DISTINCT search_text, g, {_spaced('f')} AS phrase FROM (
    SELECT search_text, g, w AS f FROM words UNION ALL SELECT search_text, g, {_TYPE_OF} FROM words
    UNION ALL SELECT search_text, g, {_DIR_OF} FROM words) WHERE {_spaced('f')} <> ''),
phrases AS (SELECT DISTINCT phrase FROM forms),
df AS (SELECT phrase, count(*) AS n_docs FROM phrases JOIN doc ON contains(doc.padded, ' ' || phrase) GROUP BY phrase),
found AS (
  SELECT f.search_text, d.doc_id, f.g, d.n_words, coalesce(df.n_docs, 0) AS n_docs,
    (length(d.padded) - length(replace(d.padded, ' ' || f.phrase, ''))) / (length(f.phrase) + 1) AS tf
  FROM forms f CROSS JOIN doc d LEFT JOIN df USING (phrase)),
matched AS (
  SELECT search_text, doc_id,
    -sum(CASE WHEN ln((n - n_docs + 0.5) / (n_docs + 0.5)) > 0 THEN ln((n - n_docs + 0.5) / (n_docs + 0.5)) ELSE 1e-6 END
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / avg_words))) AS bm25
  FROM found CROSS JOIN size GROUP BY search_text, doc_id
  HAVING count(DISTINCT CASE WHEN tf > 0 THEN g END) = count(DISTINCT g)),
hits AS (
  SELECT p.*, d.doc_id, d.city, d.city_key, d.street_key, d.province AS doc_province, d.lat, d.lon, d.min_civic, d.max_civic,
    d.address_count, d.suggest_text, m.bm25,
    row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN starts_with(d.suggest_text, p.search_text) THEN 0 ELSE 1 END,
      coalesce(round((bias_lat - d.lat) * (bias_lat - d.lat) + (bias_lon - d.lon) * (bias_lon - d.lon) * 0.53, 12), 0),
      d.address_count DESC, round(m.bm25, 9), d.doc_id) AS window_rank
  FROM prep p JOIN matched m USING (search_text) JOIN doc d USING (doc_id)
  WHERE (p.province IS NULL OR list_contains(string_split(replace(p.province, ' ', ''), ','), d.province))
    AND (box_min_lat IS NULL OR (d.lat BETWEEN box_min_lat AND box_max_lat AND d.lon BETWEEN box_min_lon AND box_max_lon))),
win AS (
  SELECT *, min(bm25) OVER w AS best, max(bm25) OVER w AS worst, max(address_count) OVER w AS top,
    CASE WHEN bias_lat IS NOT NULL THEN {O.haversine('bias_lon', 'bias_lat', 'lon', 'lat')} END AS distance,
    coalesce(civic BETWEEN min_civic AND max_civic, false) AS in_range
  FROM hits WHERE window_rank <= 50 WINDOW w AS (PARTITION BY query_id)),
scored AS (
  SELECT *, 0.4 * CASE WHEN starts_with(suggest_text, search_text) THEN 1.0
      WHEN (' ' || suggest_text) LIKE ('% ' || replace(search_text, ' ', '% ') || '%') THEN 0.6 ELSE 0.3 END
    + 0.25 * CASE WHEN worst > best THEN (worst - bm25) / (worst - best) ELSE 1.0 END
    + 0.2 * ln(1 + address_count) / ln(1 + top)
    + 0.1 * coalesce(1 / (1 + distance / 5000), 0) + 0.05 * CASE WHEN in_range THEN 1 ELSE 0 END AS score FROM win),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, address_count DESC, suggest_text, doc_id) AS rank
    FROM scored) WHERE rank <= coalesce(max_results, 7))"""


def _index(spark, sf_dir):
    addr = store(spark, sf_dir).addr
    return addr, G.StreetIndex(street_search_rows(street_ranges(addr), city_centroids(addr)))


@query("suggest_match", f"""{_SEARCH}
SELECT search_text, doc_id, round(bm25, 9) AS bm25 FROM matched""")
def suggest_match(spark, sf_dir):
    """SG1-SG6: streets that match each distinct search text, with BM25."""
    _, index = _index(spark, sf_dir)
    none = {c: F.lit(None).cast("double") for c in G.SEARCH_FIELDS if c.startswith("box") or c.startswith("bias")}
    qs = derived.search_queries(spark, sf_dir)
    prepared = G.cut_lineage(G.prepare_queries(qs), "texts").where(F.size("groups") > 0)
    texts = prepared.select("search_text", "groups").dropDuplicates(["search_text"]).withColumns(
        {"sid": F.md5("search_text"), "province": F.lit(None).cast("string"), **none}
    )
    return G.match_streets(texts, index).select("search_text", "doc_id", F.round("bm25", 9).alias("bm25"))


@query("suggest_topk", f"""{_SEARCH}
SELECT query_id, rank, doc_id, round(score, 9) AS score, CAST(floor(distance + 0.5) AS BIGINT) AS distance, in_range FROM ranked""")
def suggest_topk(spark, sf_dir):
    """SG7-SG10, WN1, WN2, WN7."""
    _, index = _index(spark, sf_dir)
    ranked = G.search_streets(derived.search_queries(spark, sf_dir), index)
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 9).alias("score"),
        F.floor(F.col("distance") + 0.5).alias("distance"), "in_range",
    )


@query("suggest_stored", f"""{_SEARCH}
SELECT query_id, rank, doc_id, round(score, 9) AS score, CAST(floor(distance + 0.5) AS BIGINT) AS distance, in_range FROM ranked""")
def suggest_stored(spark, sf_dir):
    """SG1, SG3, SG7-SG10, WN1, WN2: from a stored index, one province's segment of which was written anew."""
    addr = store(spark, sf_dir).addr
    rows = cut_lineage(street_search_rows(street_ranges(addr), city_centroids(addr)), "street_search")
    root = scratch_path(spark, "index")
    work = snapshot(spark, root).commit()
    index_streets(work, rows, [])
    work = work.publish().commit()
    index_streets(work, rows.where("province = 'ON'"), ["ON"])
    ranked = G.search_streets(derived.search_queries(spark, sf_dir), street_index(work.publish()))
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 9).alias("score"),
        F.floor(F.col("distance") + 0.5).alias("distance"), "in_range",
    )


@query("suggest_leaves", f"""{_SEARCH},
probed AS (
  SELECT *, in_range AND row_number() OVER (PARTITION BY query_id, in_range ORDER BY rank) <= 3 AS probe FROM ranked),
at_civic AS (
  SELECT city_key, street_key, civic_number, count(DISTINCT nullif(unit, '')) AS unit_total,
    arg_min(id, (CASE WHEN unit = '' THEN 0 ELSE 1 END, coalesce(TRY_CAST(nullif(regexp_extract(unit, '^[0-9]+'), '') AS BIGINT), 0), unit, id)) AS first_id
  FROM addr GROUP BY ALL),
at_unit AS (
  SELECT city_key, street_key, civic_number, upper(replace(unit, ' ', '')) AS packed, min(id) AS unit_id FROM addr WHERE unit <> '' GROUP BY ALL),
j AS (
  SELECT p.*, a.unit_total, a.first_id, u.unit_id FROM probed p
  LEFT JOIN at_civic a ON probe AND a.city_key = p.city_key AND a.street_key = p.street_key AND a.civic_number = CAST(p.civic AS VARCHAR)
  LEFT JOIN at_unit u ON probe AND p.unit <> '' AND u.city_key = p.city_key AND u.street_key = p.street_key AND u.civic_number = CAST(p.civic AS VARCHAR)
    AND u.packed = replace(p.unit, ' ', '')),
k AS (
  SELECT *, CASE WHEN NOT probe THEN 'street' WHEN first_id IS NULL THEN 'ranged' WHEN unit_id IS NOT NULL THEN 'premise'
    WHEN unit_total > 1 THEN 'building' ELSE 'premise' END AS kind FROM j)
SELECT query_id, rank, kind, CASE WHEN kind = 'building' THEN unit_total END AS unit_count,
  CASE WHEN kind IN ('premise', 'ranged') THEN 'lookup' ELSE 'search' END AS next,
  round(CASE WHEN a.id IS NOT NULL THEN a.lat ELSE k.lat END + 1e-11, 9) AS lat, round(CASE WHEN a.id IS NOT NULL THEN a.lon ELSE k.lon END + 1e-11, 9) AS lon,
  CASE WHEN a.id IS NOT NULL THEN concat_ws(', ', a.city, a.province, nullif(a.postal_code, '')) ELSE k.city || ', ' || k.doc_province END AS secondary_text,
  CASE WHEN kind = 'premise' AND a.unit <> '' THEN a.unit || '-' || k.civic WHEN kind <> 'street' THEN CAST(k.civic AS VARCHAR) ELSE '' END AS lead
FROM k LEFT JOIN addr a ON a.id = CASE WHEN kind = 'premise' AND unit_id IS NOT NULL THEN unit_id WHEN kind IN ('premise', 'building') THEN first_id END""")
def suggest_leaves(spark, sf_dir):
    """SG11-SG13."""
    addr, index = _index(spark, sf_dir)
    ranked = G.cut_lineage(G.search_streets(derived.search_queries(spark, sf_dir), index), "ranked")
    return G.resolve_leaves(ranked, addr).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "kind", "unit_count", "next",
        places("lat").alias("lat"), places("lon").alias("lon"), "secondary_text",
        F.when(F.col("kind") == "street", "").otherwise(F.substring_index("main_text", " ", 1)).alias("lead"),
    )


@query("civic_units", f"""
WITH {O.ADDR}
SELECT province, city_key, street_key, civic_number, count(DISTINCT nullif(unit, '')) AS unit_total, min(unit) AS least_unit,
  arg_min(id, (unit, id)) AS least_id FROM addr GROUP BY ALL""")
def civic_units_query(spark, sf_dir):
    """AG6, AG7."""
    return civic_units(store(spark, sf_dir).addr).select(
        "province", "city_key", "street_key", "civic_number", "unit_total",
        F.col("least.unit").alias("least_unit"), F.col("least.id").alias("least_id"),
    )


_CIVICS = """
civics AS (
  SELECT city_key, street_key, civic_number, coalesce(civic_value, 0) AS num, count(DISTINCT nullif(unit, '')) AS unit_total
  FROM addr GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY city_key, street_key ORDER BY num, civic_number) AS n,
  count(*) OVER (PARTITION BY city_key, street_key) AS total FROM civics)"""


@query("civic_page", f"""
WITH {O.ADDR}, {_CIVICS}
SELECT city_key, street_key, civic_number, n - 7 AS position, total > 14 AS more, round(1 - (n - 8) / least(total - 7, 7), 9) AS score,
  CASE WHEN unit_total > 1 THEN 'building' ELSE 'premise' END AS kind
FROM numbered WHERE n BETWEEN 8 AND 14""")
def civic_page(spark, sf_dir):
    """SG14, WN3, WN8: the second page of every street, by the cursor the first page leaves."""
    addr = store(spark, sf_dir).addr
    none = {"civic_prefix": F.lit(None).cast("string"), "after_num": F.lit(None).cast("bigint"), "after_text": F.lit(None).cast("string")}
    streets = addr.select(*G.DOC).distinct().withColumn("page_id", F.concat_ws("\t", *G.DOC))
    first = G.civic_page(streets.withColumns(none), addr)
    cursor = (
        first.where("more AND position = 7")
        .select("page_id", *G.DOC, F.col("civic_num").alias("after_num"), F.col("civic_number").alias("after_text"))
        .withColumn("civic_prefix", F.lit(None).cast("string"))
    )
    second = G.civic_page(G.cut_lineage(cursor, "cursors"), addr)
    return second.select(
        "city_key", "street_key", "civic_number", F.col("position").cast("bigint").alias("position"), "more",
        F.round("score", 9).alias("score"), "kind",
    )


@query("unit_page", f"""
WITH {O.ADDR},
u AS (SELECT city_key, street_key, civic_number, unit, id, row_number() OVER (PARTITION BY city_key, street_key, civic_number
    ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(unit, '^[0-9]+'), '') AS BIGINT), 0), unit, id) AS n,
    count(*) OVER (PARTITION BY city_key, street_key, civic_number) AS total FROM addr)
SELECT city_key, street_key, civic_number, unit, id, n AS position, total > 7 AS more FROM u WHERE n <= 7""")
def unit_page(spark, sf_dir):
    """SG14, WN4: the first page of every building."""
    addr = store(spark, sf_dir).addr
    buildings = addr.select(*G.DOC, "civic_number").distinct().withColumns(
        {
            "page_id": F.concat_ws("\t", *G.DOC, "civic_number"),
            "unit_prefix": F.lit(None).cast("string"), "after_num": F.lit(None).cast("bigint"),
            "after_text": F.lit(None).cast("string"), "after_id": F.lit(None).cast("bigint"),
        }
    )
    return G.unit_page(buildings, addr).select(
        "city_key", "street_key", "civic_number", "unit", "id", F.col("position").cast("bigint").alias("position"), "more"
    )


@query("unit_prefix", f"""
WITH {O.ADDR}
SELECT id, CASE WHEN t_civic <> '' THEN trim('X' || CASE WHEN unit_key <> '' THEN ' ' || unit_key ELSE '' END) ELSE '' END AS prefix
FROM addr_tok""")
def unit_prefix(spark, sf_dir):
    """SG15: the words after the civic number and the street."""
    addr = store(spark, sf_dir).addr
    typed = F.concat_ws(
        " ", "civic_number", F.replace(F.col("street_key"), F.lit("|"), F.lit(" ")), F.lit("x"), "unit"
    )
    # Street names of several words are one part of the key and are compared as one word.
    spaced = F.replace(F.col("street_key"), F.lit(" "), F.lit("|"))
    return addr.select("id", G.unit_prefix(typed, F.col("civic_number"), spaced).alias("prefix"))


@query("staleness", f"""
WITH {O.ADDR}, {O.STREET},
r AS (SELECT province, count(*) AS streets FROM street_c GROUP BY province),
s AS (SELECT province, count(*) AS indexed FROM street_c WHERE province = 'QC' OR street_key NOT LIKE 'KING%' GROUP BY province)
SELECT province, streets, indexed FROM r JOIN s USING (province) WHERE streets <> indexed""")
def staleness(spark, sf_dir):
    """AG5: an index built without some streets is reported."""
    ranges = street_ranges(store(spark, sf_dir).addr)
    indexed = ranges.where("province = 'QC' OR street_key NOT LIKE 'KING%'")
    return stale_provinces(ranges, indexed)
