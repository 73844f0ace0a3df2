"""Agreement and latency reports over two result sets (CP, AG14, AG15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import text
from geoweave.session import BROADCAST_MAX_ROWS, cut_lineage

# Report labels.
ERROR_HANDLED = "Error handled"
OWN_ERROR = "RL error"
OWN_REJECTED = "RL rejected"
OTHER_NOT_AVAILABLE = "OpenNorth N/A"
OWN_ONLY = "RL only"
EXPECTED_DIVERGENCE = "Expected divergence"
SAME_TRUTH_DIFFERS = "RL=ON; ground truth differs"
AGREE = "Agree"
OWN_IS_TRUTH = "RL=ground truth; ON differs"
DISAGREE = "Disagree"
OTHER_EMPTY = "ON empty"
OWN_EMPTY = "RL empty"
INCONCLUSIVE = "Inconclusive"


def classify() -> Column:
    """CP1: label of a case from category, notes, truth and both results.

    Columns: category, notes, truth, own_status, own_name, other_status, other_name, other_error; a
    null other_status means that the other side was not asked.
    """
    own = text.comparison_name(F.col("own_name"))
    other = text.comparison_name(F.col("other_name"))
    truth = text.comparison_name(F.col("truth"))
    no_other = F.coalesce(F.col("other_status"), F.lit(0)) == 0
    diverges = (F.col("category") == "F") | F.coalesce(
        F.col("notes").contains("Expected divergence"), F.lit(False)
    )
    same = (own != "") & (own == other)
    return (
        F.when((F.col("own_status") >= 400) & F.col("category").startswith("E"), ERROR_HANDLED)
        .when(F.col("own_status") >= 500, OWN_ERROR)
        .when(F.col("own_status") >= 400, OWN_REJECTED)
        .when(no_other & (text.null_to_empty(F.col("other_error")) != ""), OTHER_NOT_AVAILABLE)
        .when(no_other, OWN_ONLY)
        .when(diverges, EXPECTED_DIVERGENCE)
        .when(same & (truth != "") & (truth != own), SAME_TRUTH_DIFFERS)
        .when(same, AGREE)
        .when((own != "") & (own == truth) & (other != "") & (other != truth), OWN_IS_TRUTH)
        .when((own != "") & (other != "") & (own != other), DISAGREE)
        .when((own != "") & (other == "") & (F.col("other_status") == 200), OTHER_EMPTY)
        .when((own == "") & (other != ""), OWN_EMPTY)
        .otherwise(INCONCLUSIVE)
    )


def compare_results(cases: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """CP1: cases joined to both result tables by case_id, with their label."""
    return cases.join(own, "case_id", "left").join(other, "case_id", "left").withColumn(
        "label", classify()
    )


_PROPS = "map<string, string>"
_RESULT = (
    f"riding string, properties {_PROPS}, province_data struct<riding: string, properties: {_PROPS}>, "
    "point struct<lat: double, lon: double>, code string, error string"
)


def result_fields(raw: Column) -> Column:
    """CP2: struct of federal and provincial names, point and error from a result's JSON."""
    r = F.from_json(raw, _RESULT)
    props, prov = r["properties"], r["province_data"]
    return F.struct(
        F.coalesce(
            r["riding"], F.try_element_at(props, F.lit("FED_NAME")),
            F.try_element_at(props, F.lit("ENGLISH_NAME")),
        ).alias("federal"),
        F.coalesce(
            prov["riding"], F.try_element_at(prov["properties"], F.lit("ENGLISH_NAME"))
        ).alias("provincial"),
        F.when(r["point"]["lat"].isNotNull() & r["point"]["lon"].isNotNull(), r["point"]).alias("point"),
        r["code"].alias("code"),
        r["error"].alias("error"),
    )


_BOUNDARIES = "array<struct<name: string, related: struct<boundary_set_url: string>>>"


def postcode_names(raw: Column, boundary_set: str) -> Column:
    """CP3: names of one boundary set from a postcode answer; centroid matches are preferred."""
    r = F.from_json(raw, f"boundaries_centroid {_BOUNDARIES}, boundaries_concordance {_BOUNDARIES}")

    def names(field: str) -> Column:
        kept = F.filter(
            F.coalesce(r[field], F.array().cast(_BOUNDARIES)),
            lambda b: F.contains(F.coalesce(b["related"]["boundary_set_url"], F.lit("")), F.lit(boundary_set)),
        )
        listed = F.transform(kept, lambda b: F.coalesce(b["name"], F.lit("")))
        return F.filter(listed, lambda n: n != "")

    centroid, concordance = names("boundaries_centroid"), names("boundaries_concordance")
    return F.when(F.size(centroid) > 0, centroid).otherwise(concordance)


def stratified_sample(rows: DataFrame, group: str, order: list[str], n: int,
                      groups: list[str] | None = None) -> DataFrame:
    """CP4: the first ``n`` rows of each (named) group; the limit is applied before the shuffle."""
    named = rows if groups is None else rows.where(F.trim(group).isin(groups))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return named.withColumn("sample_no", rank).where(F.col("sample_no") <= n)


def label_counts(results: DataFrame) -> DataFrame:
    """AG15."""
    return results.groupBy("label").agg(F.count(F.lit(1)).alias("cases"))


def category_report(results: DataFrame) -> DataFrame:
    """AG15: cases, successes and agreements per category."""
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("own_status") == 200).alias("succeeded"),
        F.count_if(F.col("label") == AGREE).alias("agreed"),
    )


def error_causes(results: DataFrame) -> DataFrame:
    """AG15: causes of failed lookups, most frequent first."""
    message = text.null_to_empty(F.col("own_error"))
    cause = (
        F.when(message.contains("Circuit breaker"), "Circuit breaker open (ODA geocoding)")
        .when(message.contains("timeout"), "Geocoding timeout (30s)")
        .when(message.contains("R2 object not found"), "Missing R2 dataset")
        .otherwise(F.coalesce("own_code", F.lit("Unknown")))
    )
    failed = results.where(F.col("own_status").isNull() | (F.col("own_status") != 200))
    return failed.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("cases")).orderBy(
        F.desc("cases"), "cause"
    )


def agreement_report(results: DataFrame) -> DataFrame:
    """CP5: one row of totals over the cases where both sides named a district."""
    both = (F.col("own_status") == 200) & (text.null_to_empty(F.col("other_name")) != "")
    message = text.null_to_empty(F.col("own_error"))
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("own_status") == 200).alias("succeeded"),
        F.count_if(both).alias("both"),
        F.count_if(both & (F.col("label") == AGREE)).alias("agreed"),
        F.count_if(both & (F.col("label") == DISAGREE)).alias("disagreed"),
        F.count_if(message.contains("timeout")).alias("timeouts"),
        F.count_if(message.contains("Circuit breaker")).alias("breaker_open"),
    )


def disagreements(results: DataFrame) -> DataFrame:
    """CP5."""
    return results.where(
        (F.col("label") == DISAGREE) & (F.col("own_status") == 200)
    ).select("case_id", "own_name", "other_name", "truth")


def exact_percentiles(rows: DataFrame, group: list[str], value: str, ps: list[float],
                      buckets: int = 4096, at_once: int = 100_000) -> DataFrame:
    """AG14: sorted[min(n - 1, floor(n * p))] per group, exact, without sorting a group in one task.

    A histogram with a bounded number of buckets finds the bucket of each wanted position, and only
    the values of wanted buckets are looked at again. A bucket that still holds more than ``at_once``
    different values, as when a few far values stretch the range, is cut into buckets of its own;
    every round divides its range by ``buckets``. The last step ranks at most ``at_once`` values per
    group and position. Null groups are groups like any other.
    """
    own = [f"_g{i}" for i in range(len(group))]
    # Joins compare groups as text, with a mark for null that no group has.
    named = rows.where(F.col(value).isNotNull()).withColumns(
        {o: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for o, g in zip(own, group, strict=True)}
    )
    counted = cut_lineage(named.groupBy(*own, *group, value).agg(F.count(F.lit(1)).alias("c")), "values")
    position = F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1)
    wanted = (
        counted.groupBy(*own)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"))
        .withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps])))
        .select(*own, "p", "lo", "hi", position.alias("k"), "values")
    )
    inside = (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))
    while True:
        wanted = cut_lineage(wanted, "wanted")
        if wanted.where(F.col("values") > at_once).isEmpty():
            break
        width = (F.col("hi") - F.col("lo")) / buckets
        number = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.lit(buckets))
        per_bucket = (
            counted.join(_small(wanted), own).where(inside).withColumn("bucket", number)
            .groupBy(*own, "p", "k", "bucket")
            .agg(F.sum("c").alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("values"))
        )
        end = F.sum("c").over(Window.partitionBy(*own, "p").orderBy("bucket"))
        wanted = (
            per_bucket.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
            .where("k >= start AND k < end")
            .select(*own, "p", "lo", "hi", (F.col("k") - F.col("start")).alias("k"), "values")
        )
    up = Window.partitionBy(*own, "p").orderBy(value)
    ranked = counted.join(_small(wanted), own).where(inside).withColumn("end", F.sum("c").over(up))
    return ranked.where((F.col("k") >= F.col("end") - F.col("c")) & (F.col("k") < F.col("end"))).select(
        *group, "p", F.col(value).alias("value")
    )


def _small(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_MAX_ROWS else table
