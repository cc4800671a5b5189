"""Registered queries of the training-data operators, and their DuckDB statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import (
    bpe, clustering, divergence, line_dedup, near_vectors, packing, pii, quality, simhash, suffix_dedup, token_counts, topk, toxicity,
)
from spanveil.sources.workspace import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load every document; recount those not in English with the multilingual tokenizer; take exact copies out.

    The second batch is sent twice, as after a broken connection, and counts once.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.TokenRollup(spark, fresh_path(spark, "token-rollup"))

    def counted(some: DataFrame, version: str) -> DataFrame:
        path = public_tokenizers.path(f"{version}.tiktoken")
        return token_counts.count_tokens(some, path, public_tokenizers.PATTERN, version)

    loaded = counted(docs, "byte_bpe_50k").withColumn("action", F.lit(token_counts.INSERT))
    rollup.commit("load", loaded)
    foreign = docs.where("lang <> 'en'")
    moved = counted(foreign, "byte_bpe_multi_50k").withColumn("action", F.lit(token_counts.INSERT))
    left = foreign.select("doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("version"), F.lit(0).alias("n_tokens"), F.lit(token_counts.DELETE).alias("action"))
    for _ in range(2):
        rollup.commit("recount", moved.unionByName(left))
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = hashed.join(first, "digest").where("doc_id > first").select("doc_id")
    versions = F.explode(F.array(F.lit("byte_bpe_50k"), F.lit("byte_bpe_multi_50k")))
    empty = F.lit(None).cast("string")
    gone = copies.select("doc_id", versions.alias("version"), empty.alias("source"), empty.alias("lang"), F.lit(0).alias("n_tokens"), F.lit(token_counts.DELETE).alias("action"))
    rollup.commit("copies", gone)
    return token_counts.rollup_totals(rollup.totals())


@_query
def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


@_query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


ORACLES["op3_exact_topk"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@_query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels")))


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = f"""
WITH words AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents)),
firsts AS (
  SELECT w, len(w) AS n, min((doc_id, line_no)) AS place FROM words WHERE len(w) > 0 GROUP BY w),
cuts AS (
  SELECT place, n, i, list_concat(w[1:i - 1], w[i + 1:]) AS cut
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {line_dedup.MIN_WORDS})),
same AS (SELECT n, i, cut, min(place) AS low FROM cuts GROUP BY ALL HAVING count(*) > 1),
near AS (
  SELECT c.place FROM cuts c JOIN same s ON c.n = s.n AND c.i = s.i AND c.cut = s.cut WHERE s.low < c.place
  UNION SELECT greatest(c.place, f.place) FROM cuts c JOIN firsts f ON f.w = c.cut WHERE f.n >= {line_dedup.MIN_WORDS}),
gone AS (
  SELECT doc_id, line_no FROM words JOIN firsts USING (w)
  WHERE (doc_id, line_no) > place OR place IN (SELECT place FROM near)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents)
  WHERE (doc_id, line_no) NOT IN (SELECT (doc_id, line_no) FROM gone)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
  CAST(len(string_split(text, chr(10))) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept k USING (doc_id)
"""


@_query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@_query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), word_tokenizer())


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, most_terms=10)


ORACLES["op11_source_divergence"] = """
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT n, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
used AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER s + 2 * count(*) OVER s) AS p
  FROM every WINDOW s AS (PARTITION BY lang, source)),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER s + 2 * count(*) OVER s) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM every GROUP BY lang, term) WINDOW s AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (p - q) * (p - q) // (p + q)
  FROM shares s JOIN whole w USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""


@_query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, width=64, seed="3:")


def _clustering_sql(k: int, rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT n, vec_id, v, cluster, d FROM (
    SELECT n, vec_id, x.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d
    FROM kept x CROSS JOIN c{r} c)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, list((s - ((s % size) + size) % size) // size ORDER BY i) AS v
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS size FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i)
  GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{",".join(steps)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


ORACLES["op12_centroid_clustering"] = _clustering_sql(8, 10)


@_query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))
