"""Street index made to be stored: postings in blocks by number of addresses, one segment per province.

A search that has no bias point reads the blocks of its words from the largest streets downwards and
stops when no street of an unread block can enter its window. A segment depends on the streets of its
province only, so replacing a province rewrites nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import vocab
from geoweave.functions.geometry import planar_order
from geoweave.operators.suggest import (
    SCORED_BY, _spaced, candidate, candidate_window, checked_streets, packed_window, prefix_quality, rarest_groups,
    street_docs, text_windows, wanted_province, whole_prefix,
)
from geoweave.session import cut_lineage

# Streets per block. Each round of a search reads so many times more blocks of a word than all before it.
BLOCK = 128
GROWTH = 8
# A word's list is cut in two: streets whose text begins with it (``lead``), and the others.
LIST = ["province", "pfx", "lead"]
PLACE = [*LIST, "part", "no"]


def segments(search_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """SG1, SG3: (docs, heads, blocks, totals) of the streets given.

    A block holds at most BLOCK street ids of one list. Lists are cut where the sorted postings are cut into
    tasks, so the list of a common letter is made by many tasks. ``heads`` numbers the blocks of a list by
    their largest street and does without the ids.
    """
    docs = cut_lineage(street_docs(search_rows), "streets")
    words = F.filter(F.split(F.trim("padded"), " "), lambda w: w != "")
    prefixes = F.array_distinct(
        F.flatten(F.transform(words, lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w)), lambda n: w.substr(F.lit(1), n)
        )))
    )
    postings = docs.select(
        "province", "doc_id", "address_count", "suggest_text", F.explode(prefixes).alias("pfx")
    ).select("province", "pfx", F.startswith("suggest_text", "pfx").alias("lead"), "address_count", "doc_id")
    order = [F.desc("address_count"), F.asc("doc_id")]
    # The task's number is written with the row, so no later step depends on where the range was cut.
    ranged = cut_lineage(
        postings.repartitionByRange(*LIST, *order).withColumn("part", F.spark_partition_id()), "postings"
    )
    place = F.row_number().over(Window.partitionBy(*LIST, "part").orderBy(*order)) - 1
    blocks = cut_lineage(
        ranged.withColumn("no", F.floor(place / BLOCK)).groupBy(*PLACE).agg(
            F.max("address_count").alias("largest"),
            F.collect_list("doc_id").alias("doc_ids"),
        ),
        "blocks",
    )
    by_size = Window.partitionBy(*LIST).orderBy(F.desc("largest"), "part", "no")
    heads = blocks.select(*PLACE, "largest", F.size("doc_ids").alias("streets")).withColumn(
        "seq", F.row_number().over(by_size) - 1
    )
    totals = docs.groupBy("province").agg(
        F.count(F.lit(1)).alias("streets"), F.sum("n_words").alias("words")
    )
    return docs, heads, blocks.drop("largest"), totals


class BlockIndex:
    """The stored form of ``StreetIndex``: same searches, same results."""

    def __init__(self, docs: DataFrame, heads: DataFrame, blocks: DataFrame, totals: DataFrame):
        self.docs, self.heads, self.blocks = docs, heads, blocks
        self.postings = blocks.select("pfx", F.explode("doc_ids").alias("doc_id"))
        self.frequency = heads.groupBy("pfx").agg(F.sum("streets").alias("docs"))
        size = totals.agg(F.sum("streets"), F.sum("words")).first()
        self.n_docs = size[0] or 0
        self.avg_words = size[1] / size[0] if size[1] else 1.0

    def window(self, searches: DataFrame, size: int = vocab.SEARCH_WINDOW) -> DataFrame:
        """WN1 by rounds of blocks, scored; texts of searches by distance from a point read their rarest word whole.

        A street that begins with the whole search is in a leading block of the search's first word, any
        other match in some block of its rarest word; the blocks' largest streets bound what is still
        to come. Streets as large as the window's last are read too, as BM25 decides between them.
        """
        searches = cut_lineage(searches, "searches")
        first = F.split(_spaced(F.col("search_text")), " ")[0]
        by_size = (F.col("bias_lat").isNull() | F.col("bias_lon").isNull()) & F.startswith(F.col("search_text"), first)
        rarest = cut_lineage(rarest_groups(searches, self), "rarest")
        lists = F.concat(
            F.array(F.struct(F.lit(0).alias("tier"), first.alias("pfx"))),
            F.transform(
                F.array_distinct(F.transform("rarest", lambda f: f["head"])),
                lambda p: F.struct(F.lit(1).alias("tier"), p.alias("pfx")),
            ),
        )
        left = cut_lineage(
            searches.where(by_size).join(rarest, "sid").select(
                "sid", F.col("province").alias("want"), first.alias("first"), F.inline(lists)
            ),
            "open",
        )
        whole = text_windows(searches.where(~by_size), self, size)
        done = []
        before, upto, best = 0, 1, None
        while not left.isEmpty():
            read = self._heads_of(left, (F.col("seq") >= before) & (F.col("seq") < upto))
            fetched = (
                read.select("sid", *PLACE).distinct().join(self.blocks, PLACE)
                .select("sid", F.explode("doc_ids").alias("doc_id")).distinct()
            )
            found = checked_streets(fetched, rarest, searches, self)
            if best is not None:
                found = found.unionByName(best.select(*found.columns)).dropDuplicates(["sid", "doc_id"])
            window = cut_lineage(candidate_window(found, size), "window")
            last = window.where(F.col("window_rank") == size).select(
                "sid", F.struct(whole_prefix().alias("tier"), (-F.col("address_count")).alias("size")).alias("last")
            )
            ahead = self._heads_of(left, F.col("seq") == upto).groupBy("sid").agg(
                F.min(F.struct("tier", (-F.col("largest")).alias("size"))).alias("bound")
            )
            going = cut_lineage(
                ahead.join(last, "sid", "left").where("last IS NULL OR bound <= last").select("sid"), "going"
            )
            done.append(window.join(going, "sid", "left_anti"))
            best = window.join(going, "sid", "left_semi")
            left = cut_lineage(left.join(going, "sid", "left_semi"), "open")
            before, upto = upto, upto + upto * GROWTH
        if not done:
            return whole
        near = planar_order(F.col("bias_lon"), F.col("bias_lat"), F.col("lon"), F.col("lat"))
        rows = reduce(DataFrame.unionByName, done).withColumns(
            {"tier": whole_prefix(), "prefix": prefix_quality(F.col("suggest_text"), F.col("search_text"))}
        )
        return whole.unionByName(packed_window(rows.select(*SCORED_BY, candidate(near, F.col).alias("candidate"))))

    def _heads_of(self, left: DataFrame, which) -> DataFrame:
        """Heads of the lists that each search reads: leading blocks of its first word, all of the rarest."""
        twice = (F.col("pfx") == F.col("first")) & F.col("lead")
        return left.join(self.heads.where(which), "pfx").where(
            F.when(F.col("tier") == 0, F.col("lead")).otherwise(~twice)
            & wanted_province(F.col("want"), F.col("province"))
        )
