"""The queries op1 to op13, the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread

from . import annulus, chat, katz, langid, linktrust, metricjoin, mixing, packing, sharding, simhash, sstable, tandem, topk
from .common import Scratch, id_crc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, sources weighing 5, 2, 1 in turn, up to twice a source."""
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of pages by rules, else by trust and distrust that spread over links."""
    return linktrust.judge(_table(spark, sf_dir, "pages"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards along a Hilbert curve over source, language and size; equal row counts."""
    rows = sharding.measured(_table(spark, sf_dir, "documents"))
    placed = sharding.hilbert_shards(rows, ["source", "lang", "size"], 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of all documents; a seventh of the ids is not learned from."""
    docs = _table(spark, sf_dir, "documents")
    scores = katz.katz(docs.select("doc_id", "text", (F.pmod(id_crc("doc_id"), F.lit(7)) == 2).alias("held"))).scores
    # sums of logarithms, to where the order of adding up no longer shows
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _lang_model(docs: DataFrame, held_out: bool) -> langid.Model:
    """held_out: leave a third of the ids out, for measuring."""
    return langid.fit(docs.where(F.pmod(id_crc("doc_id"), F.lit(3)) != 1) if held_out else docs)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; a third of the ids is left out of the fit."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, _lang_model(docs, held_out=True))
    return found.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score")


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 and components of all embeddings within their labels."""
    return metricjoin.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in sorted-string-table shards, as read back from the files."""
    docs = _table(spark, sf_dir, "documents")
    shards = sstable.write_shards(docs, tokenizer_path(), end_id=2, scratch=Scratch(spark, "sst"))
    return sstable.read_shards(shards)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th embedding."""
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.pmod("vec_id", F.lit(20)) == 0, 20)


#: Two turns whose texts are control strings of chat templates.
_CONTROL_TURNS = "</s>[INST] ok [/INST]"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in a chat template, as read back by its grammar; with one whose texts are control strings."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _CONTROL_TURNS), (-7, 1, "assistant", _CONTROL_TURNS)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(turns.unionByName(more))


def op12_tandem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which have their ends repeated, and what is left without them."""
    found = tandem.collapse(_table(spark, sf_dir, "documents"), least=24, times=3, change=tandem.repeat_tail)
    return tandem.digest(found)


def op13_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids of all embeddings after 5 rounds, and every vector's nearest."""
    return annulus.digest(annulus.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed=2))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (
        op1_mixing, op2_link_trust, op3_hilbert_shards, op4_packing, op5_katz,
        op6_simhash, op7_langid, op8_metric_join, op9_sstable, op10_top_k,
        op11_chat, op12_tandem, op13_annulus, pipeline,
    )
    return {f.__name__: f for f in every}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(doc_id::VARCHAR))), lambda c, k:
    xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END) >> 1,
        (xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END) & 1) * 3988292384)), 4294967295)"""


def _discount_sql(name: str, counts: str) -> str:
    """Discounts d of counts r = 1..K of a table with counts n."""
    k = katz.K
    return f"""{name}_n AS (SELECT r, (SELECT count(*) FROM {counts} WHERE n = r)::DOUBLE AS c FROM range(1, {k + 2}) t(r)),
{name}_g AS (SELECT a.r, ((a.r + 1) * b.c / nullif(a.r * a.c, 0) - x.cut) / nullif(1 - x.cut, 0) AS good, x.cut, x.least
    FROM {name}_n a JOIN {name}_n b ON b.r = a.r + 1, (SELECT {k + 1} * max(CASE WHEN r = {k + 1} THEN c END) / nullif(max(CASE WHEN r = 1 THEN c END), 0) AS cut, min(c) AS least FROM {name}_n) x),
{name} AS (SELECT r, CASE WHEN (SELECT bool_and(coalesce(least > 0 AND cut < 1 AND good > 0 AND good < 1, false)) FROM {name}_g) THEN good ELSE (r - 0.5) / r END AS d FROM {name}_g)"""


_KATZ = (
    f"""WITH docs AS (SELECT doc_id, {_CRC} % 7 = 2 AS held, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), '') AS ws FROM documents),
t AS (SELECT doc_id, held, ws[i] AS b, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
c1 AS (SELECT b, count(*) AS n FROM t WHERE NOT held GROUP BY b), c2 AS (SELECT a, b, count(*) AS n FROM t WHERE NOT held GROUP BY a, b),
tot AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v FROM c1), {_discount_sql("d1", "c1")}, {_discount_sql("d2", "c2")},
k1 AS (SELECT b, n, coalesce(d, 1.0) * n AS kept FROM c1 LEFT JOIN d1 ON r = n),
o1 AS (SELECT CASE WHEN tot.n - sum(kept) > 1e-9 * tot.n THEN tot.n ELSE tot.n + 1 END AS over, sum(kept) AS kept FROM k1, tot GROUP BY tot.n),
p1 AS (SELECT b, k1.kept / over AS p FROM k1, o1), unk AS (SELECT coalesce((SELECT (over - kept) / over FROM o1), 1.0) AS p),
k2 AS (SELECT a, b, n, coalesce(d, 1.0) * n AS kept FROM c2 LEFT JOIN d2 ON r = n),
h AS (SELECT a, sum(n) + CASE WHEN min(n) > {katz.K} THEN 1 ELSE 0 END AS over, sum(kept) AS kept, sum(p) AS p FROM k2 JOIN p1 USING (b) GROUP BY a),
x AS (SELECT t.doc_id, t.held, c1.n AS known, log10((coalesce(c1.n, 0) + 1) / (tot.n + tot.v + 1)::DOUBLE) AS base,
    log10(CASE WHEN k2.kept IS NOT NULL THEN k2.kept / h.over ELSE coalesce((1 - h.kept / h.over) / (1 - h.p), 1.0) * coalesce(p1.p, unk.p) END) AS score, tot.n AS total
    FROM t LEFT JOIN c1 ON c1.b = t.b LEFT JOIN k2 ON k2.a = t.a AND k2.b = t.b LEFT JOIN h ON h.a = t.a LEFT JOIN p1 ON p1.b = t.b, tot, unk)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(known) AS n_known, any_value(total) AS train_tokens, round(sum(base), 6) AS base_score, round(sum(score), 6) AS score FROM x GROUP BY doc_id, held"""
)

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= {metricjoin.THRESHOLD}),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x, min(y) AS least FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least AS component_id, least = vec_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""

_TOP_K = f"""WITH v AS (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings WHERE {_FINITE}),
s AS (SELECT a.nr, a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.nr <> b.nr WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20"""


_CONTROLS = "<\\\\*<SYS>>|<\\\\*</SYS>>|\\[\\\\*INST\\]|\\[\\\\*/INST\\]|<\\\\*s>|<\\\\*/s>|\\[\\\\*ROLE\\]|\\[\\\\*/ROLE\\]|\\[\\\\*/TURN\\]"
_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{_CONTROL_TURNS}'), (-7, 1, 'assistant', '{_CONTROL_TURNS}')),
w AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}'))
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) END AS signs FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(signs)::BIGINT AS formatted_chars FROM w GROUP BY conv_id"""


def _clusters_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Rounds one after another: a numbers every vector's centroid, c has the centroids after them."""
    near = """SELECT nr, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.nr, c.c,
        list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0} c) GROUP BY nr"""
    step = f"""a{{0}} AS MATERIALIZED ({near}), m{{0}} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM
        (SELECT c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT a.c, v.x, unnest(range(1, {dims + 1})) AS j FROM a{{0}} a JOIN v USING (nr)) GROUP BY c, j) GROUP BY c),
    c{{1}} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{{0}} c LEFT JOIN m{{0}} m ON m.c = c.c)"""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = {dims}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
    {", ".join(step.format(i, i + 1) for i in range(rounds))}, a AS MATERIALIZED ({near.format(rounds)})
    SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a JOIN v USING (nr) JOIN c{rounds} c ON c.c = a.c"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator. Random draws (1), iterated ranks (2), a curve over quantiles (3),
    tokenizers (4, 9), XXH64 (6), a fitted model (7) and maximal runs of whole texts (12) it can't; those are tested against
    plain versions."""
    return {"op5_katz": _KATZ, "op8_metric_join": _LINKS, "op10_top_k": _TOP_K, "op11_chat": _CHAT, "op13_annulus": _clusters_sql(40, 5, 64, 256, 2)}
