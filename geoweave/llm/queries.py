"""Registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import bpe, centroids, exact, licenses, merkle, packing, pieces, shards, simhash, token_counts, toxicity, vectors, warc
from geoweave.llm.common import prepared
from geoweave.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express it or is too slow on whole tables."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: prepared(spark).read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# A-Z alone in lower case, as DuckDB writes it.
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_simhash")
def op1(table):
    """Near-duplicate components of all documents."""
    return simhash.near_groups(table("documents")).select(
        "doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id"
    )


@query("op6_toxicity")
def op6(table):
    """Toxicity scores of all documents."""
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op7_packing")
def op7(table):
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table("documents"))


@query(
    "op10_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def op10(table):
    """Exact duplicates of all documents; the largest id of each group stays."""
    return exact.exact_groups(table("documents"), keep="largest")


@query("op2_license_scan", licenses.scan_sql())
def op2(table):
    """Lines and texts of all documents that are like a licence notice."""
    return licenses.scan(table("documents"))


@query("op8_warc")
def op8(table):
    """All pages written to WARC archives and read back."""
    pages = table("pages")
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = warc.write_archives(pages, folder)
    return warc.read_chunks(pages.sparkSession, manifest, folder, payload=False).where("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


@query("op9_token_shards")
def op9(table):
    """Token sequences of all documents written in training order and read back."""
    docs = table("documents")
    folder = scratch_path(docs.sparkSession, "shards")
    manifest = shards.write_shards(docs, folder)
    return shards.read_slots(docs.sparkSession, manifest, folder).select(
        "slot", "shard", "doc_id", "piece", "length", F.crc32("ids").alias("ids_crc32")
    )


@query("op3_token_counts")
def op3(table):
    """Token counts of all documents before and after three edits of each."""
    states = token_counts.build_trees(table("documents")).withColumn("edits", token_counts.sample_edits())
    edited = token_counts.apply_edits(states)
    return edited.select(
        "doc_id", "tokens_before", F.element_at("tokens", 2).alias("tokens_after"), F.element_at("chars", 2).alias("chars_after"),
        "recounted_chars", F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query("op4_sampled_pieces")
def op4(table):
    """Three distinct sampled segmentations of every document."""
    return pieces.sample(table("documents"), with_ids=False)


@query("op5_near_vectors")
def op5(table):
    """Near-duplicate embeddings: links and components."""
    return vectors.near_vectors(table("embeddings"))


# Unsigned CRC-32 of a short decimal text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT for i in range(1, 1 + length(doc_id::VARCHAR))]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in merkle.FIELDS) + ")"


def _tree(name: str, start: str) -> str:
    """Recursive table of all levels of the trees that ``start`` (tree, idx, n, digest) begins, and their runs."""
    return f"""
    {name} AS (
      SELECT tree, idx, n, digest, 0 AS depth FROM {start}
      UNION ALL
      SELECT tree, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value(depth) + 1
      FROM {name} WHERE n > 1 GROUP BY tree, idx // 3
    ),
    {name}_runs AS (
      SELECT tree, depth, idx // 3 AS run, list(digest ORDER BY idx) AS digests FROM {name} WHERE n > 1 GROUP BY ALL
    )"""


def _path(name: str, start: str, trees: str) -> str:
    """Recursive table that folds the rows of ``start`` (row, tree, idx, digest, proof) up their tree."""
    return f"""
    {name} AS (
      SELECT row, tree, idx, digest, proof, 0 AS depth FROM {start}
      UNION ALL
      SELECT p.row, p.tree, p.idx // 3,
             sha256(array_to_string(r.digests[1 : p.idx % 3], '') || p.digest || array_to_string(r.digests[p.idx % 3 + 2 :], '')),
             p.proof || array_to_string(r.digests[1 : p.idx % 3], '') || array_to_string(r.digests[p.idx % 3 + 2 :], ''),
             p.depth + 1
      FROM {name} p JOIN {trees}_runs r ON r.tree = p.tree AND r.depth = p.depth AND r.run = p.idx // 3
    ),
    {name}_end AS (SELECT * FROM {name} QUALIFY depth = max(depth) OVER (PARTITION BY row))"""


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
      SELECT *, row_number() OVER () AS row, coalesce(':' || source, '') AS tree, {_leaf("text")} AS digest,
             CASE WHEN coalesce({_CRC32} % 2 = 0, false) THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered
      FROM documents
    ),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
             count(*) OVER (PARTITION BY tree) AS n FROM leaves
    ),
    {_tree("low", "placed")},
    tops AS (
      SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest, tree AS key
      FROM low WHERE n = 1
    ),
    {_tree("high", "tops")},
    low_start AS (SELECT row, tree, idx, tampered AS digest, '' AS proof FROM placed),
    {_path("climbed", "low_start", "low")},
    high_start AS (
      SELECT c.row, 0 AS tree, t.idx, c.digest, c.proof FROM climbed_end c JOIN tops t ON t.key = c.tree
    ),
    {_path("topped", "high_start", "high")},
    last AS (SELECT digest AS root FROM high WHERE n = 1)
    SELECT p.doc_id, p.digest AS leaf, t.digest AS subroot, l.root, sha256(e.proof) AS proof_sha256,
           e.digest AS folded_root, e.digest = l.root AS verified
    FROM placed p JOIN tops t ON t.key = p.tree JOIN topped_end e ON e.row = p.row CROSS JOIN last l
    """,
)
def op12(table):
    """Every document's leaf, proof and check against the root of all documents."""
    return merkle.tamper_check(table("documents"))


def _rounds() -> str:
    """Starting centroids, then per round the assignment of all vectors and the centroids that follow."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v FROM kept
      ORDER BY cluster LIMIT 8)"""
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
      SELECT k.row, arg_min(c.cluster, ({square}, c.cluster)) AS cluster, min({square}) AS distance
      FROM kept k CROSS JOIN c{i} c GROUP BY k.row)""")
        if i < centroids.ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT cluster, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY d) AS v FROM (
          SELECT cluster, d, sum(x)::HUGEINT AS s, count(*) AS n
          FROM (SELECT a.cluster, unnest(k.v) AS x, unnest(range(len(k.v))) AS d FROM a{i} a JOIN kept k USING (row))
          GROUP BY cluster, d) GROUP BY cluster) m USING (cluster))""")
    return ", ".join(parts)


@query(
    "op13_centroids",
    f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), {_rounds()}
    SELECT k.vec_id, a.cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
           (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{centroids.ROUNDS} a JOIN kept k USING (row) JOIN c{centroids.ROUNDS} c USING (cluster)
    """,
)
def op13(table):
    """Clusters of all embeddings after ten rounds from eight hashed starts."""
    return centroids.cluster(table("embeddings"))


@query("op11_byte_bpe")
def op11(table):
    """All documents encoded by merge ranks and decoded again."""
    coded = bpe.decode(bpe.encode(table("documents")))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
