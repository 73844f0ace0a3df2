"""Agreement and latency reports over two derived result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.operators import compare as C
from geoweave.plans import oracle_parts as O
from geoweave.plans.registry import query
from geoweave.sources import derived

_NAME = lambda x: f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '-', '—', 'g'), '\\s+', ' ', 'g')))"
_CASES = derived.CASES_SQL.format(orders="orders")
_LABELS = f"""
WITH cases AS ({_CASES}),
named AS (
  SELECT *, coalesce(own_raw->>'$.riding', own_raw->>'$.properties.FED_NAME') AS own_name, own_raw->>'$.province_data.properties.ENGLISH_NAME' AS own_prov,
    own_raw->>'$.code' AS own_code, own_raw->>'$.error' AS own_error,
    CASE WHEN other_status = 200 THEN CASE WHEN other_raw->>'$.boundaries_centroid[0].related.boundary_set_url' LIKE '%federal%' THEN other_raw->>'$.boundaries_centroid[0].name'
      ELSE other_raw->>'$.boundaries_concordance[0].name' END END AS other_name FROM cases),
n AS (SELECT *, {_NAME('own_name')} AS a, {_NAME('other_name')} AS b, {_NAME('truth')} AS g FROM named),
l AS (
  SELECT *, CASE WHEN own_status >= 400 AND category = 'E' THEN 'Error handled' WHEN own_status >= 500 THEN 'RL error' WHEN own_status >= 400 THEN 'RL rejected'
    WHEN coalesce(other_status, 0) = 0 THEN CASE WHEN other_error IS NOT NULL THEN 'OpenNorth N/A' ELSE 'RL only' END
    WHEN category = 'F' OR coalesce(notes LIKE '%Expected divergence%', false) THEN 'Expected divergence'
    WHEN a <> '' AND a = b THEN CASE WHEN g <> '' AND g <> a THEN 'RL=ON; ground truth differs' ELSE 'Agree' END
    WHEN a <> '' AND a = g AND b <> '' THEN 'RL=ground truth; ON differs' WHEN a <> '' AND b <> '' THEN 'Disagree'
    WHEN a <> '' AND other_status = 200 THEN 'ON empty' WHEN b <> '' THEN 'RL empty' ELSE 'Inconclusive' END AS label FROM n)"""


def _results(spark, sf_dir):
    raw = derived.comparison_cases(spark, sf_dir)
    own = raw.withColumn("r", C.result_fields(F.col("own_raw"))).select(
        "case_id", "own_status", "ms", F.col("r.federal").alias("own_name"), F.col("r.provincial").alias("own_prov"),
        F.col("r.code").alias("own_code"), F.col("r.error").alias("own_error"),
    )
    names = C.postcode_names(F.col("other_raw"), "federal")
    other = raw.select(
        "case_id", "other_status", "other_error",
        F.when(F.col("other_status") == 200, F.try_element_at(names, F.lit(1))).alias("other_name"),
    )
    return C.compare_results(raw.select("case_id", "category", "notes", "truth"), own, other)


@query("agreement", f"{_LABELS} SELECT case_id, own_name, own_prov, other_name, label FROM l")
def agreement(spark, sf_dir):
    """CP1-CP3."""
    return _results(spark, sf_dir).select("case_id", "own_name", "own_prov", "other_name", "label")


@query("label_counts", f"{_LABELS} SELECT label, count(*) AS cases FROM l GROUP BY label")
def label_counts(spark, sf_dir):
    """AG15."""
    return C.label_counts(_results(spark, sf_dir))


@query("category_report", f"""{_LABELS}
SELECT category, count(*) AS cases, count(*) FILTER (WHERE own_status = 200) AS succeeded, count(*) FILTER (WHERE label = 'Agree') AS agreed FROM l GROUP BY category""")
def category_report(spark, sf_dir):
    """AG15."""
    return C.category_report(_results(spark, sf_dir))


@query("error_causes", f"""{_LABELS}
SELECT CASE WHEN own_error LIKE '%Circuit breaker%' THEN 'Circuit breaker open (ODA geocoding)' WHEN own_error LIKE '%timeout%' THEN 'Geocoding timeout (30s)'
  ELSE coalesce(own_code, 'Unknown') END AS cause, count(*) AS cases FROM l WHERE own_status <> 200 GROUP BY 1""")
def error_causes(spark, sf_dir):
    """AG15."""
    return C.error_causes(_results(spark, sf_dir))


@query("agreement_report", f"""{_LABELS}
SELECT count(*) AS cases, count(*) FILTER (WHERE own_status = 200) AS succeeded, count(*) FILTER (WHERE own_status = 200 AND coalesce(other_name, '') <> '') AS "both",
  count(*) FILTER (WHERE own_status = 200 AND coalesce(other_name, '') <> '' AND label = 'Agree') AS agreed,
  count(*) FILTER (WHERE own_status = 200 AND coalesce(other_name, '') <> '' AND label = 'Disagree') AS disagreed,
  count(*) FILTER (WHERE own_error LIKE '%timeout%') AS timeouts, count(*) FILTER (WHERE own_error LIKE '%Circuit breaker%') AS breaker_open FROM l""")
def agreement_report(spark, sf_dir):
    """CP5."""
    return C.agreement_report(_results(spark, sf_dir))


@query("disagreements", f"{_LABELS} SELECT case_id, own_name, other_name, truth FROM l WHERE label = 'Disagree' AND own_status = 200")
def disagreements(spark, sf_dir):
    """CP5."""
    return C.disagreements(_results(spark, sf_dir))


@query("stratified_sample", f"""
WITH addr_raw AS ({O.ADDR_RAW})
SELECT city, id FROM (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY id) AS n FROM addr_raw WHERE city IN ('SCARBOROUGH', 'Ottawa', 'Montréal')) WHERE n <= 20""")
def stratified_sample(spark, sf_dir):
    """CP4: the sample size is the feature."""
    addr = derived.addresses(spark, sf_dir)
    return C.stratified_sample(addr, "city", ["id"], 20, ["SCARBOROUGH", "Ottawa", "Montréal"]).select("city", "id")


@query("latency_percentile", f"""
WITH log AS ({O.LOG}),
s AS (SELECT route, ms, row_number() OVER (PARTITION BY route ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY route) AS n FROM log)
SELECT route, p, ms AS value FROM s CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)) v(p) WHERE k = least(n - 1, CAST(floor(n * p) AS BIGINT))""")
def latency_percentile(spark, sf_dir):
    """AG14."""
    return C.exact_percentiles(derived.request_log(spark, sf_dir), ["route"], "ms", [0.5, 0.95, 0.99])
