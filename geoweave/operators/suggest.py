"""Street search over a table of query strings: prefix match, BM25, score, leaves and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import text, vocab
from geoweave.functions.geometry import haversine, planar_order
from geoweave.operators.aggregates import civic_units
from geoweave.operators.parse import parse_address
from geoweave.operators.skew import hot_keys, salted_join, spread_join
from geoweave.session import BROADCAST_MAX_ROWS, cut_lineage

DOC = ["province", "city_key", "street_key"]
# Streets of one text that lie in one row, about, and queries of one search that one task scores.
STREETS_PER_ROW = 1024
QUERIES_PER_TASK = 100_000


def _spaced(value: Column) -> Column:
    """'-' and '/' split words in the index."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, "[/-]", " "), " +", " "))


def street_docs(search_rows: DataFrame) -> DataFrame:
    """SG1: searchable streets with their id, their text as it is searched and its number of words."""
    spaced = _spaced(F.col("suggest_text"))
    return search_rows.withColumns(
        {
            "doc_id": F.concat_ws("\t", "city_key", "street_key"),
            "padded": F.concat(F.lit(" "), spaced),
            "n_words": F.size(F.split(spaced, " ")),
        }
    )


class StreetIndex:
    """SG1, SG3: searchable streets, the words' prefixes, and how many streets each prefix is in."""

    def __init__(self, search_rows: DataFrame):
        self.docs = cut_lineage(street_docs(search_rows), "streets")
        # Every prefix of every word, once per street; a word has as many prefixes as letters.
        prefixes = (
            self.docs.select("doc_id", F.explode(F.array_distinct(F.split(F.trim("padded"), " "))).alias("w"))
            .select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n"))
            .select("doc_id", F.substring(F.col("w"), F.lit(1), F.col("n")).alias("pfx"))
            .distinct()
        )
        self.postings = cut_lineage(prefixes, "prefixes")
        self.frequency = self.postings.groupBy("pfx").agg(F.count(F.lit(1)).alias("docs"))
        size = self.docs.agg(F.count(F.lit(1)), F.avg("n_words")).first()
        self.n_docs, self.avg_words = size[0], size[1] or 1.0

    def window(self, searches: DataFrame) -> DataFrame:
        """The scored window of each distinct search, from all its matches."""
        return text_windows(searches, self)


def prepare_queries(queries: DataFrame, min_length: int = vocab.SEARCH_MIN_LENGTH) -> DataFrame:
    """SG2, SG5-SG7: search text, civic, unit, word groups and an error code.

    Too short a query is not an error: it gets no groups and so no rows. A word group holds the word
    itself and its canonical street type and direction; all groups must match.
    """
    parsed = parse_address(queries, "q", "p_").withColumns(
        {
            "normalized": text.search_token(F.col("q")),
            "civic": text.leading_int(F.col("p_civic")),
            "unit": text.normalize_unit(F.col("p_unit")),
        }
    )
    words = F.split("normalized", " ")
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    stripped = F.when((F.size(words) > 1) & words[0].rlike("[0-9]"), rest).otherwise(F.col("normalized"))
    parsed = parsed.withColumn(
        "search_text",
        F.when(F.col("civic").isNotNull(), stripped).otherwise(F.col("normalized")),
    )

    def group(word: Column) -> Column:
        forms = F.array(word, text.canonical_type(word), text.canonical_direction(word))
        return F.filter(F.array_distinct(F.transform(forms, _spaced)), lambda p: p != "")

    listed = F.filter(F.split("search_text", " "), lambda w: w != "")
    groups = F.filter(F.transform(listed, group), lambda g: F.size(g) > 0)
    both = F.col("bias_lat").isNotNull() & F.col("box_min_lat").isNotNull()
    enough = (F.length("normalized") >= min_length) & ~both
    no_groups = F.array().cast("array<array<string>>")
    return parsed.drop("p_civic", "p_name", "p_type", "p_direction", "p_unit").withColumns(
        {
            "error_code": F.when(both, "INVALID_QUERY"),
            "groups": F.when(enough, groups).otherwise(no_groups),
        }
    )


# What decides the candidate window of a query, apart from its civic number and unit.
SEARCH_FIELDS = [
    "search_text", "groups", "province", "bias_lat", "bias_lon",
    "box_min_lat", "box_max_lat", "box_min_lon", "box_max_lon",
]


def _search_id() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_FIELDS if c != "groups"]
    return F.md5(F.concat_ws("\u0001", *parts))


def phrase_frequency(phrases: DataFrame, index: StreetIndex) -> DataFrame:
    """(phrase, head, n_docs): streets with the phrase; its last word may be a prefix.

    A one-word phrase is looked up; only phrases of several words are checked against streets.
    """
    named = phrases.select("phrase").distinct().withColumn("head", F.substring_index("phrase", " ", 1))
    looked = named.join(index.frequency.withColumnRenamed("pfx", "head"), "head", "left")
    several = looked.where(F.col("phrase").contains(" "))
    checked = (
        several.join(index.postings.withColumnRenamed("pfx", "head"), "head")
        .join(index.docs.select("doc_id", "padded"), "doc_id")
        .where(F.contains(F.col("padded"), F.concat(F.lit(" "), F.col("phrase"))))
        .groupBy("phrase").agg(F.count(F.lit(1)).alias("exact"))
    )
    return looked.join(checked, "phrase", "left").select(
        "phrase", "head",
        F.coalesce("docs", F.lit(0)).alias("head_docs"),
        F.when(F.col("phrase").contains(" "), F.coalesce("exact", F.lit(0)))
        .otherwise(F.coalesce("docs", F.lit(0))).alias("n_docs"),
    )


def match_streets(searches: DataFrame, index: StreetIndex) -> DataFrame:
    """SG3, SG4: streets that match all word groups of each distinct search, with BM25.

    ``searches`` has sid and SEARCH_FIELDS. Streets are fetched through each search's rarest group
    only and the other groups are checked on the street's text, so a word that a third of all
    streets contain costs nothing unless it is all there is.
    """
    rarest = rarest_groups(searches, index)
    fetched = (
        rarest.select("sid", F.explode(F.array_distinct(F.transform("rarest", lambda f: f["head"]))).alias("pfx"))
        .join(index.postings, "pfx")
        .select("sid", "doc_id")
        .distinct()
    )
    return checked_streets(fetched, rarest, searches, index)


def rarest_groups(searches: DataFrame, index: StreetIndex) -> DataFrame:
    """(sid, rarest, all_forms): the word group with the fewest streets of each search, and all forms of all groups."""
    words = searches.select("sid", F.posexplode("groups").alias("group_no", "forms")).select(
        "sid", "group_no", F.explode("forms").alias("phrase")
    )
    counted = words.join(phrase_frequency(words, index), "phrase")
    per_group = counted.groupBy("sid", "group_no").agg(
        F.sum("head_docs").alias("docs"),
        # A group holds at most three forms.
        F.collect_set(F.struct("phrase", "head", "n_docs")).alias("forms"),
    )
    return per_group.groupBy("sid").agg(
        F.min_by("forms", F.struct("docs", "group_no")).alias("rarest"),
        F.flatten(F.collect_list("forms")).alias("all_forms"),  # as many as the query has words
    )


def wanted_province(asked: Column, province: Column) -> Column:
    """A search names one province, several with commas between, or none."""
    listed = F.split(F.replace(asked, F.lit(" "), F.lit("")), ",")
    return asked.isNull() | F.array_contains(listed, province)


def checked_streets(fetched: DataFrame, rarest: DataFrame, searches: DataFrame, index: StreetIndex) -> DataFrame:
    """Of the fetched (sid, doc_id) those that match all groups, box and province, with BM25."""
    weighed = rarest.select("sid", "all_forms").join(
        searches.select("sid", *[c for c in SEARCH_FIELDS]), "sid"
    )
    padded = F.col("padded")
    all_match = F.forall(
        "groups",
        lambda g: F.exists(g, lambda p: F.contains(padded, F.concat(F.lit(" "), p))),
    )
    in_box = F.col("box_min_lat").isNull() | (
        F.col("lat").between(F.col("box_min_lat"), F.col("box_max_lat"))
        & F.col("lon").between(F.col("box_min_lon"), F.col("box_max_lon"))
    )
    wanted = wanted_province(F.col("want_province"), F.col("province"))
    return (
        fetched.join(weighed.withColumnRenamed("province", "want_province"), "sid")
        .join(index.docs, "doc_id")
        .where(all_match & in_box & wanted)
        .withColumn("bm25", bm25(F.col("all_forms"), padded, F.col("n_words"), index))
        .drop("all_forms", "groups")
    )


def bm25(forms: Column, padded: Column, n_words: Column, index: StreetIndex) -> Column:
    """SG4: published formula over all forms of a query, negated so that smaller is better."""
    k1, b = vocab.BM25_K1, vocab.BM25_B
    length = k1 * (1 - b + b * n_words / index.avg_words)

    def part(form: Column) -> Column:
        needle = F.concat(F.lit(" "), form["phrase"])
        gone = F.length(padded) - F.length(F.replace(padded, needle, F.lit("")))
        tf = gone / F.length(needle)
        raw = F.ln((index.n_docs - form["n_docs"] + 0.5) / (form["n_docs"] + 0.5))
        idf = F.when(raw > 0, raw).otherwise(1e-6)
        return idf * tf * (k1 + 1) / (tf + length)

    return -F.aggregate(F.transform(forms, part), F.lit(0.0), lambda acc, x: acc + x)


def whole_prefix() -> Column:
    """0 where the street's text starts with the whole search, else 1."""
    return F.when(F.col("suggest_text").startswith(F.col("search_text")), 0).otherwise(1)


def candidate_window(matches: DataFrame, size: int = vocab.SEARCH_WINDOW) -> DataFrame:
    """WN1, WN7: best ``size`` streets per search.

    The limit is pushed below the shuffle by the engine, so a search with very many matches sends
    only ``size`` rows per task.
    """
    near = planar_order(F.col("bias_lon"), F.col("bias_lat"), F.col("lon"), F.col("lat"))
    order = [
        whole_prefix(),
        F.coalesce(F.round(near, 12), F.lit(0.0)),
        F.desc("address_count"),
        F.round("bm25", 9),
        F.asc("doc_id"),
    ]
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(*order))
    return matches.withColumn("window_rank", rank).where(F.col("window_rank") <= size)


def prefix_quality(suggest_text: Column, search_text: Column) -> Column:
    """SG9: 1 for a whole prefix, 0.6 when the words prefix the street's words in order, else 0.3."""
    words = F.split(suggest_text, " ")

    def step(cursor: Column, word: Column) -> Column:
        later = F.slice(words, F.greatest(cursor, F.lit(1)), F.size(words))
        at = F.array_position(F.transform(later, lambda w: F.startswith(w, word)), True).cast("int")
        return F.when((cursor > 0) & (at > 0), cursor + at).otherwise(0)

    asked = F.filter(F.split(search_text, " "), lambda w: w != "")
    in_order = F.aggregate(asked, F.lit(1), step) > 0
    return (
        F.when(search_text == "", 0.3)
        .when(F.startswith(suggest_text, search_text), 1.0)
        .when(in_order, 0.6)
        .otherwise(0.3)
    )


def candidate(near: Column, street) -> Column:
    """A street of a window: first what orders the window, then what scores the street. ``street`` gives its columns."""
    return F.struct(
        street("tier").alias("tier"), F.coalesce(F.round(near, 12), F.lit(0.0)).alias("near"),
        (-street("address_count")).alias("less"), F.round(street("bm25"), 9).alias("rounded"),
        street("doc_id").alias("doc_id"),
        *[street(c).alias(c) for c in ("bm25", "prefix", "lat", "lon", "suggest_text", "min_civic", "max_civic")],
    )


def scored_window(top: Column) -> Column:
    """SG8 without the civic number, for the candidates of one window: base, tie (place among equal scores), doc_id and civic range."""
    weights = vocab.SEARCH_WEIGHTS
    whole = F.struct(
        F.array_min(F.transform(top, lambda c: c["bm25"])).alias("best"),
        F.array_max(F.transform(top, lambda c: c["bm25"])).alias("worst"),
        (-F.array_min(F.transform(top, lambda c: c["less"]))).alias("most"),
    )
    by_tie = F.sort_array(F.transform(top, lambda c: F.struct(
        c["less"].alias("less"), c["suggest_text"].alias("suggest_text"), c["doc_id"].alias("doc_id"), c.alias("c")
    )))

    def scored(w: Column, row: Column, tie: Column) -> Column:
        c = row["c"]
        span = w["worst"] - w["best"]
        bm25_norm = F.when(span > 0, (w["worst"] - c["bm25"]) / span).otherwise(1.0)
        popularity = F.when(w["most"] > 0, F.log1p(-c["less"]) / F.log1p(w["most"])).otherwise(0.0)
        proximity = F.coalesce(1 / (1 + _distance(c["lat"], c["lon"]) / 5000), F.lit(0.0))
        base = (
            weights["prefix"] * c["prefix"]
            + weights["bm25"] * bm25_norm
            + weights["popularity"] * popularity
            + weights["proximity"] * proximity
        )
        return F.struct(
            base.alias("base"), tie.alias("tie"), c["doc_id"].alias("doc_id"),
            c["min_civic"].alias("min_civic"), c["max_civic"].alias("max_civic"),
        )

    # The window's extremes are a lambda's variable, so they are computed once and not per street.
    return F.transform(F.array(whole), lambda w: F.transform(by_tie, lambda r, i: scored(w, r, i)))[0]


def _distance(lat: Column, lon: Column) -> Column:
    return F.when(F.col("bias_lat").isNotNull(), haversine(F.col("bias_lon"), F.col("bias_lat"), lon, lat))


# What the score of a window takes from its search.
SCORED_BY = ["sid", "bias_lat", "bias_lon"]


def packed_window(rows: DataFrame) -> DataFrame:
    """(sid, streets): scored windows from rows with SCORED_BY and a ``candidate`` each, a window's size per search at most."""
    top = rows.groupBy("sid").agg(
        F.first("bias_lat").alias("bias_lat"), F.first("bias_lon").alias("bias_lon"), F.collect_list("candidate").alias("top")
    )
    return top.select("sid", scored_window(F.col("top")).alias("streets"))


def text_matches(searches: DataFrame, index: StreetIndex) -> DataFrame:
    """SG3, SG4: streets that match each distinct search text, wherever they lie."""
    none = {c: F.lit(None).cast("double") for c in SEARCH_FIELDS if c.startswith("box") or c.startswith("bias")}
    texts = searches.select("search_text", "groups").dropDuplicates(["search_text"]).withColumns(
        {"sid": F.md5("search_text"), "province": F.lit(None).cast("string"), **none}
    )
    return match_streets(texts, index)


def text_windows(searches: DataFrame, index: StreetIndex, size: int = vocab.SEARCH_WINDOW) -> DataFrame:
    """WN1, WN7: (sid, streets), the scored window of each search, from all matches of its text.

    Searches of one text that differ in province, box or bias point share its matches, which lie in rows of
    about STREETS_PER_ROW; a search meets these rows and keeps ``size`` streets of each, so matches
    are neither looked up nor shuffled per search.
    """
    matches = cut_lineage(
        text_matches(searches, index).select(
            "search_text", "doc_id", "province", "lat", "lon", "address_count", "bm25", "suggest_text",
            "min_civic", "max_civic", whole_prefix().alias("tier"),
            prefix_quality(F.col("suggest_text"), F.col("search_text")).alias("prefix"),
        ),
        "matches",
    )
    parts = matches.groupBy("search_text").agg(F.ceil(F.count(F.lit(1)) / STREETS_PER_ROW).alias("parts"))
    packed = (
        matches.join(parts, "search_text")
        .groupBy("search_text", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct(*[c for c in matches.columns if c != "search_text"])).alias("matched"))
    )
    packed = cut_lineage(packed.drop("part"), "packed")
    asked = searches.drop("groups")
    if matches.count() <= BROADCAST_MAX_ROWS:
        met = asked.join(F.broadcast(packed), "search_text")
    else:
        met = spread_join(asked, packed, ["search_text"], ["sid"], "inner")

    def kept(s: Column) -> Column:
        in_box = F.col("box_min_lat").isNull() | (
            s["lat"].between(F.col("box_min_lat"), F.col("box_max_lat"))
            & s["lon"].between(F.col("box_min_lon"), F.col("box_max_lon"))
        )
        return in_box & wanted_province(F.col("province"), s["province"])

    def placed(s: Column) -> Column:
        return candidate(planar_order(F.col("bias_lon"), F.col("bias_lat"), s["lon"], s["lat"]), lambda c: s[c])

    top = F.slice(F.sort_array(F.transform(F.filter("matched", kept), placed)), 1, size)
    best = met.select(*SCORED_BY, "parts", top.alias("top")).where(F.size("top") > 0)
    done = best.where("parts = 1").select("sid", scored_window(F.col("top")).alias("streets"))
    if packed.where("parts > 1").isEmpty():
        return done
    several = best.where("parts > 1").select(*SCORED_BY, F.explode("top").alias("candidate"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("candidate"))
    return done.unionByName(packed_window(several.withColumn("window_rank", rank).where(F.col("window_rank") <= size)))


def search_streets(queries: DataFrame, index: StreetIndex, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """SG2-SG10, WN1, WN2, WN7: ranked streets per query.

    Equal searches are matched once; a query's civic number enters only in the final score. A query meets its
    window as one row and keeps the streets it asked for before anything is sorted by query. A query
    may have its own ``max_results``; ``limit`` is for those without.
    """
    if "max_results" not in queries.columns:
        queries = queries.withColumn("max_results", F.lit(None).cast("int"))
    prepared = cut_lineage(
        prepare_queries(queries).withColumn("sid", _search_id()), "search_queries"
    ).where(F.size("groups") > 0)
    searches = cut_lineage(prepared.select("sid", *SEARCH_FIELDS).dropDuplicates(["sid"]), "searches")
    asked = F.least(F.greatest(F.coalesce("max_results", F.lit(limit)), F.lit(1)), F.lit(vocab.SEARCH_WINDOW))
    by_query = prepared.select(
        "query_id", "sid", "civic", "unit", "search_text", "bias_lat", "bias_lon", asked.alias("asked")
    )
    counts = by_query.groupBy("sid").agg(F.count(F.lit(1)).alias("_rows"))
    met = salted_join(
        by_query, index.window(searches), ["sid"], ["query_id", "civic"], "inner",
        hot_keys(counts, ["sid"], "_rows", QUERIES_PER_TASK),
    )

    def ranked(s: Column) -> Column:
        in_range = F.coalesce(F.col("civic").between(s["min_civic"], s["max_civic"]), F.lit(False))  # SG10
        score = s["base"] + vocab.SEARCH_WEIGHTS["civic"] * F.when(in_range, 1.0).otherwise(0.0)
        return F.struct(
            (-F.round(score, 9)).alias("order"), s["tie"].alias("tie"), s["doc_id"].alias("doc_id"),
            score.alias("score"), in_range.alias("in_range"),
        )

    best = F.slice(F.sort_array(F.transform("streets", ranked)), F.lit(1), F.col("asked"))
    hits = (
        met.withColumn("hit", F.explode(best)).drop("streets")
        .withColumns({c: F.col("hit")[c] for c in ("doc_id", "score", "in_range")}).drop("hit")
        .join(index.docs.drop("padded", "n_words"), "doc_id")
        .withColumn("distance", _distance(F.col("lat"), F.col("lon")))
    )
    # Queries may share an id: then their rows are ranked together.
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", 9)), F.desc("address_count"), F.asc("suggest_text"), F.asc("doc_id")
    )
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("asked")).drop("asked")


def match_ranges(label: Column, search_text: Column) -> Column:
    """SG13: [start, end) of each query word's first place in the folded label."""
    haystack = text.search_token(label)
    words = F.filter(F.split(search_text, " "), lambda w: w != "")
    spans = F.transform(
        words,
        lambda w: F.struct(
            (F.instr(haystack, w) - 1).alias("start"), (F.instr(haystack, w) - 1 + F.length(w)).alias("end")
        ),
    )
    return F.filter(spans, lambda s: s["start"] >= 0)


def _join_text(*parts: Column) -> Column:
    return F.concat_ws(", ", *[text.empty_to_null(p) for p in parts])


def resolve_leaves(ranked: DataFrame, addr: DataFrame) -> DataFrame:
    """SG11, SG12: result rows; up to three in-range streets per query become addresses.

    The result kind is street, premise (one address), building (several units) or ranged (the civic
    number is in range but not stored).
    """
    first_ranges = Window.partitionBy("query_id", "in_range").orderBy("rank")
    probe = F.col("in_range") & (F.row_number().over(first_ranges) <= vocab.SEARCH_MAX_LEAVES)
    keyed = ranked.withColumns(
        {"probe": probe, "civic_number": F.col("civic").cast("string"),
         "unit_packed": F.replace(F.col("unit"), F.lit(" "), F.lit(""))}
    )

    def leaf_label(leaf: str) -> Column:
        parts = [text.empty_to_null(F.col(f"{leaf}.{c}")) for c in ("street_name", "street_type", "street_direction")]
        return text.street_label(F.concat_ws("|", *parts))

    # Labels are made per street, civic number and unit, not per result.
    labels = cut_lineage(
        addr.select("street_key").distinct().withColumn("street_label", text.street_label(F.col("street_key"))), "labels"
    )
    few = labels.count() <= BROADCAST_MAX_ROWS
    keyed = keyed.join(F.broadcast(labels) if few else labels, "street_key", "left")
    units = civic_units(addr).withColumn("first_label", leaf_label("first"))
    by_unit = (
        addr.where("unit <> ''")
        .groupBy(*DOC, "civic_number", F.upper(F.replace(F.col("unit"), F.lit(" "), F.lit(""))).alias("unit_packed"))
        .agg(
            F.min_by(
                F.struct("unit", "postal_code", "street_name", "street_type", "street_direction", "city", "lat", "lon", "id"),
                F.struct(F.coalesce(text.leading_int(F.col("unit")), F.lit(0)), "unit", "id"),
            ).alias("unit_row")
        )
        .withColumn("unit_label", leaf_label("unit_row"))
    )
    keys = [*DOC, "civic_number"]
    probed = (
        keyed.where("probe")
        .join(units.select(*keys, "first", "first_label", "unit_total"), keys, "left")
        .join(by_unit, keys + ["unit_packed"], "left")
    )
    others = keyed.where("NOT probe").withColumns(
        {
            "first": F.lit(None).cast(probed.schema["first"].dataType),
            "unit_total": F.lit(None).cast("bigint"),
            "unit_row": F.lit(None).cast(probed.schema["unit_row"].dataType),
            "first_label": F.lit(None).cast("string"),
            "unit_label": F.lit(None).cast("string"),
        }
    )
    rows = probed.unionByName(others)
    unit_hit = (F.col("unit") != "") & F.col("unit_row").isNotNull()
    kind = (
        F.when(~F.col("probe"), "street")
        .when(F.col("first").isNull(), "ranged")
        .when(unit_hit, "premise")
        .when(F.col("unit_total") > 1, "building")
        .otherwise("premise")
    )
    rows = rows.withColumn("kind", kind).withColumn(
        "leaf",
        F.when(F.col("kind").isin("premise", "building"), F.when(unit_hit, F.col("unit_row")).otherwise(F.col("first"))),
    )
    of_leaf = F.when(unit_hit, F.col("unit_label")).otherwise(F.col("first_label"))
    rows = rows.withColumn("label", F.when(F.col("leaf").isNotNull(), of_leaf).otherwise(F.col("street_label")))
    is_leaf = F.col("leaf").isNotNull()
    unit_text = F.when((F.col("kind") == "premise") & (F.col("leaf.unit") != ""), F.concat("leaf.unit", F.lit("-"))).otherwise("")
    main = F.when(F.col("kind") == "street", F.col("label")).otherwise(
        F.trim(F.concat(unit_text, F.col("civic_number"), F.lit(" "), F.col("label")))
    )
    secondary = F.when(
        is_leaf, _join_text(F.col("leaf.city"), F.col("province"), F.col("leaf.postal_code"))
    ).otherwise(_join_text(F.col("city"), F.col("province")))
    rows = rows.withColumns({"main_text": main, "secondary_text": secondary})
    stop = F.col("kind").isin("premise", "ranged")
    return rows.select(
        "query_id", "rank", "kind", F.col("score"),
        F.concat_ws(", ", "main_text", "secondary_text").alias("text"),
        "main_text", "secondary_text",
        F.when(F.col("kind") == "street", match_ranges(F.col("label"), F.col("search_text"))).alias("matches"),
        F.when(stop, "lookup").otherwise("search").alias("next"),
        F.when(F.col("kind") == "street", "Street").when(F.col("kind") == "ranged", "RangedPremise")
        .otherwise("Premise").alias("data_level"),
        (F.length("main_text") + F.when(stop, 0).otherwise(1)).alias("cursor"),
        F.when(is_leaf, F.col("leaf.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(is_leaf, F.col("leaf.lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(F.col("kind") == "street", F.col("address_count"))
        .when(F.col("kind") == "building", F.col("unit_total")).alias("address_count"),
        F.when(F.col("kind") == "building", F.col("unit_total")).alias("unit_count"),
        F.floor(F.col("distance") + 0.5).alias("distance"),
        F.struct(
            *DOC, F.when(F.col("kind") == "building", F.col("civic_number")).alias("civic_number")
        ).alias("container"),
    )


def civic_page(pages: DataFrame, addr: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """AG7, SG14, WN3, WN8: one page of civic numbers per requested street.

    ``pages`` has page_id and the street, an optional civic_prefix, and the keyset cursor after_num
    and after_text (null for a first page). ``more`` tells whether another page follows.
    """
    value = F.coalesce(text.leading_int(F.col("civic_number")), F.lit(0))
    listed = (
        pages.join(civic_units(addr), DOC)
        .withColumn("civic_num", value)
        .where(
            F.col("civic_prefix").isNull()
            | F.startswith(F.col("civic_number"), F.col("civic_prefix"))
        )
        .where(
            F.col("after_num").isNull()
            | (F.col("civic_num") > F.col("after_num"))
            | ((F.col("civic_num") == F.col("after_num")) & (F.col("civic_number") > F.col("after_text")))
        )
    )
    page = _page(listed, ["civic_num", "civic_number"], limit)
    return page.withColumn(
        "kind", F.when(F.col("unit_total") > 1, "building").otherwise("premise")
    )


def unit_page(pages: DataFrame, addr: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """SG14, WN4, WN8: one page of addresses per requested building, in unit order.

    The cursor (after_num, after_text, after_id) is compared on the very tuple that orders the page,
    so pages neither skip nor repeat.
    """
    listed = (
        pages.join(addr.select(*DOC, "civic_number", "unit", "id", "lat", "lon", "postal_code"), DOC + ["civic_number"])
        .withColumn("unit_num", F.coalesce(text.leading_int(F.col("unit")), F.lit(0)))
        .where(
            F.col("unit_prefix").isNull()
            | F.startswith(
                F.upper(F.replace(F.col("unit"), F.lit(" "), F.lit(""))),
                F.replace(F.col("unit_prefix"), F.lit(" "), F.lit("")),
            )
        )
        .where(
            F.col("after_num").isNull()
            | (F.struct("unit_num", "unit", "id") > F.struct("after_num", "after_text", "after_id"))
        )
    )
    return _page(listed, ["unit_num", "unit", "id"], limit)


def _page(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    ranked = rows.withColumn(
        "position", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    ).where(F.col("position") <= limit + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    return (
        ranked.withColumn("_n", n)
        .where(F.col("position") <= limit)
        .withColumns(
            {
                "more": F.col("_n") > limit,
                "score": 1 - (F.col("position") - 1) / F.least(F.col("_n"), F.lit(limit)),
            }
        )
        .drop("_n")
    )


def unit_prefix(q: Column, civic: Column, street_key: Column) -> Column:
    """SG15: what a query adds after the civic number and the street words, in order."""
    words = F.filter(F.split(text.search_token(q), " "), lambda w: w != "")
    expected = F.filter(F.concat(F.array(civic), F.split(street_key, r"\|")), lambda p: p != "")
    used = F.aggregate(
        expected,
        F.lit(0),
        lambda i, part: i + F.when(F.try_element_at(words, i + 1).eqNullSafe(part), 1).otherwise(0),
    )
    return F.array_join(F.slice(words, used + 1, F.greatest(F.size(words) - used, F.lit(0))), " ")
