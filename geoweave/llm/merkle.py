"""Merkle manifest of a table: a tree per group of rows, a tree over the groups, and a proof for every row.

A digest H is the SHA-256 of its inputs put together, where digests enter as lowercase hex text. Digests
are kept as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import take, written
from geoweave.operators.skew import spread_join
from geoweave.session import BROADCAST_MAX_ROWS

ARITY = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PART_BITS = 33  # a monotonically increasing id is a partition's number, then 33 bits of place


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``order``, nulls first, as column ``at``.

    Rows are dealt by range, with a number of their own last, so that equal rows spread as well. Each task
    numbers its range, and one row per range carries the counts on.
    """
    kept = written(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_tag", F.monotonically_increasing_id())
        .drop("_tie"),
        name,
    ).withColumn("_part", F.shiftright("_tag", _PART_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_tag") - F.shiftleft("_part", _PART_BITS)
    return kept.join(F.broadcast(ranges), "_part").withColumn("at", at).drop("_part", "_tag", "_before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (``tree``, ``idx``, ``digest``, more) with their siblings' digests, ``left`` and ``right`` of them.

    For each of the other places in a run the index of the sibling is computed from the node's own, by
    XOR for pairs and else by a shift of the slot, and the nodes are joined with themselves on it.
    """
    slot = F.col("idx") % arity
    joined = nodes
    for shift in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        other = nodes.select("tree", F.col("idx").alias("_sibling"), F.col("digest").alias(f"_s{shift}"))
        joined = joined.withColumn("_sibling", at).join(other, ["tree", "_sibling"], "left").drop("_sibling")
    none = F.lit(b"")

    def side(left: bool) -> Column:
        wrapped = [(slot + s >= arity) == F.lit(left) for s in range(1, arity)]
        return F.concat(*[F.when(w, F.coalesce(f"_s{s}", none)).otherwise(none) for s, w in enumerate(wrapped, 1)])

    return joined.withColumn("left", side(True)).withColumn("right", side(False)).drop(*[f"_s{s}" for s in range(1, arity)])


def climb(nodes: DataFrame, most: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Every level of the trees of ``nodes`` (``tree``, ``idx``, ``n``, ``digest``), and their last nodes.

    ``n`` is the number of nodes of a tree on this level and ``most`` the largest. A level is one
    written table of the nodes that have a run to join, with their siblings; its rows in slot zero give
    the next level. A tree whose level has one node is done: ``tree``, ``depth``, ``digest``.
    """
    levels, last = [], []

    def done() -> DataFrame:
        return nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("depth"), "digest")

    last.append(done())
    while most > 1:
        level = written(with_siblings(nodes.where("n > 1"), arity), f"{name}_{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest(shown(F.col("digest")), shown(F.col("right"))).alias("digest"),
        )
        most = -(-most // arity)
        last.append(done())
    tops = last[0]
    for more in last[1:]:
        tops = tops.unionByName(more)
    return levels, written(tops, f"{name}_tops")


def descend(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame | None:
    """The nodes of the lowest level with ``path``, their siblings up to the root, and the other columns of ``above``.

    ``above`` has for each tree its ``depth`` and the ``path`` from its last node on. Going down, a node's
    path is its own siblings and the path of its parent, so each level is joined once, with one
    a third of its size.
    """
    more = [c for c in above.columns if c not in ("tree", "depth")]
    parents = None
    for depth in range(len(levels) - 1, -1, -1):
        ended = above.where(F.col("depth") == depth + 1).select("tree", F.lit(0).cast("bigint").alias("parent"), *more)
        if parents is None:
            parents = ended
        else:
            parents = parents.select("tree", F.col("idx").alias("parent"), *more).unionByName(ended)
        own = levels[depth].withColumn("parent", F.expr(f"idx div {arity}"))
        joined = own.join(parents, ["tree", "parent"]).drop("parent")
        parents = joined.withColumn("path", F.concat(F.array(F.struct("left", "right")), "path"))
    return parents


def fold(start: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf and the siblings on its path give."""
    return F.aggregate(
        path, shown(start), lambda acc, s: F.sha2(F.concat(shown(s["left"]), acc, shown(s["right"])), 256)
    )


def proof_text(path: Column) -> Column:
    """All digests of a path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(shown(s["left"]), shown(s["right"]))), "")


def manifest(leaves: DataFrame, order: list[str], arity: int = ARITY) -> tuple[DataFrame, DataFrame, str | None]:
    """Trees over ``leaves``: the leaves with their proofs, the trees, and the root of all as hex text.

    ``leaves`` has ``key`` (string, the group of a row, null allowed), ``digest`` (binary) and further
    columns, among them those of ``order``, by which the leaves of a group are ordered, nulls first and
    equal rows by their digest. Runs of ``arity`` consecutive nodes, the last one perhaps shorter,
    become one node until one is left; a group's lone leaf is its subroot. The subroots, ordered by key
    (null first, then by bytes), become the root in the same way.

    The leaves come back with ``path`` (array of the siblings left and right, up to the root) and
    ``subroot``; the trees are rows of ``key``, ``n`` (leaves) and ``subroot``. No leaves give no rows and no root.

    A group may hold any share of the rows: leaves are numbered and joined by number, never gathered by
    group. Rows whose columns are all equal are leaves of their own, in any order.
    """
    rows = written(leaves.withColumn("key", F.coalesce(F.concat(F.lit(":"), "key"), F.lit(""))), "merkle_leaves")
    placed = numbered(rows, ["key", *order, "digest"], "merkle_placed")
    groups = written(placed.groupBy("key").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")), "merkle_groups")
    number, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    if not number:
        empty = rows.select("*", F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))).alias("path"), F.col("digest").alias("subroot"))
        return empty, groups.select("key", "n", F.lit(None).cast("binary").alias("subroot")), None
    trees = written(numbered(groups, ["key"], "merkle_keys").withColumnRenamed("at", "tree"), "merkle_trees")
    if number <= BROADCAST_MAX_ROWS:
        joined = placed.join(F.broadcast(trees), "key")
    else:
        joined = spread_join(written(placed, "merkle_at"), trees, ["key"], ["at"], "inner")
    nodes = written(joined.withColumn("idx", F.col("at") - F.col("start")).drop("at", "start", "key"), "merkle_nodes")

    levels, tops = climb(nodes, most, arity, "merkle_level")
    upper = tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(number).alias("n"), "digest")
    top_levels, top = climb(upper, number, arity, "merkle_top")
    root = top.select(shown(F.col("digest"))).first()[0]

    no_path = F.array().cast("array<struct<left:binary,right:binary>>")
    above = descend(top_levels, top.select("tree", "depth", no_path.alias("path")), arity)
    if above is None:
        over = upper.select(F.col("idx").alias("tree"), no_path.alias("path"))
    else:
        over = above.select(F.col("idx").alias("tree"), "path")
    above = tops.withColumnRenamed("digest", "subroot").join(over, "tree")
    if len(levels) > 1:
        above = written(above, "merkle_above")
    own = [c for c in rows.columns if c != "key"]
    proofs = nodes.where("n = 1").join(above, "tree").select(*own, "path", "subroot")
    deep = descend(levels, above, arity)
    if deep is not None:
        proofs = deep.select(*own, "path", "subroot").unionByName(proofs)
    key = F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("key")
    subroots = tops.select("tree", F.col("digest").alias("subroot"))
    return proofs, trees.join(subroots, "tree").select(key, "n", "subroot"), root


def tamper_check(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Whether the rows of ``docs`` (``doc_id``, ``source``, ``lang``, ``n_chars``, ``text``) still prove against their root.

    Trees are built per source over the rows as they are, by ``manifest``. Then each row whose id, as
    decimal text, has an even CRC-32 loses the line feeds of its text, its leaf is computed again and folded
    with the siblings of the untouched trees. A row is verified when that gives the root, so rows
    without a line feed, with a null text or with a null id are.

    Result, one row per row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``,
    ``verified``. Null fields enter a leaf as ``-``, empty texts as ``0:``; texts of any length are hashed
    where they are read and never moved. Repeated ids are ordered by their leaves; repeated rows
    have the same leaf and one place each. No rows give no rows. Other columns are ignored.
    """
    rows = take(docs, *FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    stripped = F.when(even, F.translate("text", "\n", ""))
    leaves = rows.select(
        "doc_id",
        F.col("source").alias("key"),
        leaf([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(stripped != F.col("text"), leaf([stripped if c == "text" else F.col(c) for c in FIELDS])).alias("forged"),
    )
    proofs, _, root = manifest(leaves, ["doc_id"], arity)
    folded = proofs.withColumn("folded_root", fold(F.coalesce("forged", "digest"), F.col("path")))
    return folded.select(
        "doc_id",
        shown(F.col("digest")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        F.lit(root).cast("string").alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
