"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.llm import chat, fingerprints, licenses, merkle, mixing, orchard, packing, pii, prefixes, rules, shards, simhash, warc
from famloom.llm.common import fresh, scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Conversation -1: both turns say control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.digests(turns.unionByName(extra))


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(_table(spark, sf_dir, "documents")).drop("spans")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("key", "doc_id").withColumn("host_rate", F.round("host_rate", 9)).drop("host")


def op4_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/packages-{uuid.uuid4().hex}"
    return warc.records(warc.packages(_table(spark, sf_dir, "pages"), folder)).drop("url", "record_id")


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rate = fresh(docs, "rate")[0]
    out = mixing.mix(docs)
    return out.withColumn(rate, F.round(rate, 9))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


def op12_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.counted(_table(spark, sf_dir, "documents"))


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.clusters(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_prefix_tree, op2_license_templates, op3_host_rules, op4_pii_semi_markov, op5_best_fit_packing, op6_warc_zip, op7_multiset_hash, op8_simhash_variants, op9_virtual_slots, op10_poisson_mixing, op11_merkle_manifest, op12_prefix_token_counts, op13_orchard_clusters, pipeline)
    return {f.__name__: f for f in own}


def _chat_sql() -> str:
    t = chat.Template()
    marks = " + ".join(f"2 * ((length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)})" for c in t.control)
    escaped = lambda x: f"length({x}) + length({x}) - length(replace({x}, chr(92), '')) + {marks.replace('{0}', x)}"
    size = f"{len(t.open) + 1 + len(t.close)} + {escaped('role')} + length(role) - length(replace(role, chr(10), '')) + {escaped('text')}"
    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({size}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_SPACE = r"[\x20\x09-\x0D]"
_RULES_SQL = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {rules.WINDOW}),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {rules.WINDOW - 1}], ' ')) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS j FROM win WHERE c > 1) GROUP BY doc_id),
lin AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE length(regexp_replace(l, '{_SPACE}', '', 'g')) > 0 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lin.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lin ON lin.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT avg(bad / n) AS m, coalesce(var_samp(bad / n), 0) AS v, avg(1.0::DOUBLE / n) AS inv FROM h),
k AS (SELECT m, least(greatest(CASE WHEN v - m * (1 - m) * inv > 0 THEN (m * (1 - m) - v) / (v - m * (1 - m) * inv) ELSE {rules.STRONGEST} END, {rules.WEAKEST}), {rules.STRONGEST}) AS k FROM g),
l AS (SELECT m, k, least(greatest(m + {rules.SPREAD} * sqrt(m * (1 - m) / (k + 1)), {rules.LEAST_LIMIT}), {rules.MOST_LIMIT}) AS top FROM k),
s AS (SELECT source, n, bad, top, k, (bad + m * k) / (n + k) AS rate FROM h, l),
r AS (SELECT source, n, bad, rate, rate - {rules.CREDIBLE} * sqrt(rate * (1 - rate) / (n + k + 1)) > top AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, r.n AS host_docs, CAST(r.bad AS BIGINT) AS host_failures, round(CAST(r.rate AS DOUBLE), 9) AS host_rate,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM f LEFT JOIN r ON r.source = f.source"""

_WARC_SQL = f"""WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= {warc.LEAST} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to FROM q"""

_MIX_SQL = f"""WITH RECURSIVE s AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes) AS b, sum(pow(CAST(bytes AS DOUBLE), {mixing.TEMPERATURE})) AS w FROM s),
r AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE CAST(b AS DOUBLE) * (pow(CAST(bytes AS DOUBLE), {mixing.TEMPERATURE}) / w) / bytes END AS rate FROM s, t),
c(source, rate, k, lp, cdf) AS (
  SELECT source, rate, CAST(0 AS BIGINT), -rate, exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), cdf + exp(lp + ln(rate) - ln(k + 1)) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (SELECT *, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(source, 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.*, r.rate, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf < u.u) AS copies FROM u JOIN r ON r.source IS NOT DISTINCT FROM u.source),
e AS (SELECT *, unnest(range(copies)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies, copy, md5('place{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS place FROM e"""



def _merkle_sql() -> str:
    """Trees level by level; crc32 by its table."""
    value = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join(value(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    return f"""WITH RECURSIVE bits(i, k, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, {step.format("v")} FROM bits WHERE k < 8),
tab AS (SELECT i, v FROM bits WHERE k = 8),
crc(doc_id, s, c) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s[2:], xor(c >> 8, v) FROM crc JOIN tab ON tab.i = xor(c, ascii(s[1])) % 256 WHERE s <> ''),
odd AS (SELECT doc_id FROM crc WHERE s = '' AND xor(c, 4294967295) % 2 = 0),
leaves AS (
  SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM odd) THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS seen FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
low(lvl, tree, idx, digest, n) AS (
  SELECT 0, tree, place, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL SELECT lvl + 1, tree, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY lvl, tree, idx // 3, n),
high(lvl, tree, idx, digest, n) AS (
  SELECT 0, -1, tree, digest, count(*) OVER () FROM low WHERE n = 1
  UNION ALL SELECT lvl + 1, tree, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, tree, idx // 3, n),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
sib AS (
  SELECT lvl, tree, idx, n, coalesce(string_agg(digest, '' ORDER BY idx) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY idx) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW r AS (PARTITION BY lvl, tree, idx // 3 ORDER BY idx)),
walk(doc_id, leaf, place, tree, lvl, top, node, path) AS (
  SELECT doc_id, leaf, place, tree, 0, false, seen, '' FROM placed
  UNION ALL
  SELECT w.doc_id, w.leaf, w.place, w.tree, CASE WHEN m.n = 1 THEN 0 ELSE w.lvl + 1 END, w.top OR m.n = 1,
    CASE WHEN m.n = 1 THEN w.node ELSE sha256(m.l || w.node || m.r) END, CASE WHEN m.n = 1 THEN w.path ELSE w.path || m.l || m.r END
  FROM walk w JOIN sib m ON m.lvl = w.lvl AND m.tree = CASE WHEN w.top THEN -1 ELSE w.tree END AND m.idx = CASE WHEN w.top THEN w.tree ELSE w.place END // CAST(pow(3, w.lvl) AS BIGINT)
  WHERE NOT (w.top AND m.n = 1)),
ends AS (SELECT * FROM walk WHERE top QUALIFY row_number() OVER (PARTITION BY doc_id, leaf, place, tree ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(path) AS proof_sha256, node AS folded_root, node = t.digest AS verified
FROM ends e JOIN low s ON s.tree = e.tree AND s.n = 1, (SELECT digest FROM high WHERE n = 1) t"""


def _orchard_sql() -> str:
    """Rounds written out; every distance is worked out."""
    k, n = orchard.CENTROIDS, orchard.DIMENSION
    out = f"""WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({orchard.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n}),
p AS (SELECT row_number() OVER () AS r, vec_id, v FROM q),
x AS (SELECT r, unnest(range(1, {n + 1})) AS i, unnest(v) AS a FROM p),
f AS (SELECT row_number() OVER (ORDER BY sha256('{orchard.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id IS NULL, v) - 1 AS c, r FROM p QUALIFY c < {k}),
c0 AS (SELECT c, i, a FROM f JOIN x USING (r))"""
    for t in range(orchard.ROUNDS + 1):
        out += f""",
d{t} AS (SELECT r, c, CAST(sum((x.a - m.a) * (x.a - m.a)) AS BIGINT) AS d FROM x JOIN c{t} m USING (i) GROUP BY r, c),
n{t} AS (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
c{t + 1} AS (SELECT o.c, o.i, coalesce(u.a, o.a) AS a FROM c{t} o LEFT JOIN (
  SELECT c, i, (sum(a) - ((sum(a) % count(*)) + count(*)) % count(*)) // count(*) AS a FROM n{t} JOIN x USING (r) GROUP BY c, i) u ON u.c = o.c AND u.i = o.i)"""
    t = orchard.ROUNDS
    return f"""{out}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM n{t} JOIN p USING (r) JOIN (SELECT c, sha256(string_agg(CAST(a AS VARCHAR), ',' ORDER BY i)) AS h FROM c{t} GROUP BY c) s USING (c)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are held against brute force in tests."""
    return {"op1_chat_prefix_tree": _chat_sql(), "op3_host_rules": _RULES_SQL, "op6_warc_zip": _WARC_SQL, "op10_poisson_mixing": _MIX_SQL, "op11_merkle_manifest": _merkle_sql(), "op13_orchard_clusters": _orchard_sql()}
