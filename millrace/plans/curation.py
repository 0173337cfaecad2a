"""Queries on documents and pages: masks, rules, dedup, HTML, archives, classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import gopher, html, pii
from millrace.functions import text as tx
from millrace.operators import classify, dedup
from millrace.scratch import Scratch
from millrace.session import spread, table
from millrace.sources import text as source
from millrace.sources import warc

PARAMS = dedup.MinHash(hashes=100, bands=10, ngrams=5, threshold=0.8)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _digest(column: str):
    return F.md5(F.encode(column, "UTF-8"))


def _masked(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = _docs(spark, d).select("doc_id", pii.mask(F.col("text"), kind).alias("m"))
        return found.select("doc_id", _digest("m.text").alias("masked_md5"), F.col("m.n").alias("n"))

    return query


def mask_all(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", pii.mask_all(F.col("text")).alias("t")).select("doc_id", _digest("t").alias("masked_md5"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _mask_sql(kind: str) -> str:
    pattern, with_ = map(_quote, pii.MASKS[kind])
    return f"""SELECT doc_id, md5(regexp_replace(text, {pattern}, {with_}, 'g')) AS masked_md5,
        len(regexp_extract_all(text, {pattern}))::BIGINT AS n FROM documents"""


def _mask_all_sql() -> str:
    x = "text"
    for pattern, with_ in pii.MASKS.values():
        x = f"regexp_replace({x}, {_quote(pattern)}, {_quote(with_)}, 'g')"
    return f"SELECT doc_id, md5({x}) AS masked_md5 FROM documents"


def gopher_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", gopher.n_words(t).alias("n_words"), F.round(gopher.mean_word_length(t), 6).alias("mean_word_length"),
        F.round(gopher.ellipsis_share(t), 6).alias("ellipsis_share"), F.round(gopher.alphabetic_share(t), 6).alias("alphabetic_share"),
    )


_GOPHER = r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words,
    CASE WHEN len(words) > 0 THEN length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE / len(words) ELSE 0.0 END AS mean_word_length,
    len(list_filter(lines, lambda x: x LIKE '%...'))::DOUBLE / len(lines) AS ellipsis_share,
    CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::DOUBLE / len(words) ELSE 0.0 END AS alphabetic_share FROM w)
"""
_RULES = {
    "f1": "n_words BETWEEN 50 AND 100000",
    "f2": "mean_word_length BETWEEN 3 AND 10",
    "f3": "ellipsis_share <= 0.3",
    "f4": "alphabetic_share >= 0.8",
}


def _gopher(rule: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).where(gopher.rules(F.col("text"))[rule]).select("doc_id")

    return query


def gopher_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(gopher.passes(F.col("text"))).select("doc_id")


def line_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dedup.line_frequency(_docs(spark, d)).select(_digest("line").alias("line_md5"), "n")


def exact_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_lines(_docs(spark, d)).select("doc_id", _digest("text").alias("text_md5"))


def exact_doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_documents(_docs(spark, d)).select("doc_id", "n")


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    signed = dedup.signatures(_docs(spark, d), PARAMS)
    return signed.select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",").cast("binary")).alias("signature_md5"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a bucket, of different normalised texts, and each further copy of a text with the first."""
    firsts, copies = _firsts(spark, d)
    banded = Scratch(spark, "bands").table(dedup.bands(dedup.signatures(firsts, PARAMS), PARAMS), "bands")  # both sides of a join read it
    return dedup.candidates(banded).unionByName(copies)


def _firsts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text of the first document of each normalised text; a, b: that document and each other of the same text)."""
    docs = _docs(spark, d)
    normal = docs.select("doc_id", tx.normalised(F.col("text")).alias("t")).where("t <> ''").select("doc_id", _digest("t").alias("digest"))
    normal = Scratch(spark, "firsts").table(normal, "normal")
    first = normal.groupBy("digest").agg(F.min("doc_id").alias("a"))
    copies = normal.join(first, "digest").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return docs.select("doc_id", "text").join(first.select(F.col("a").alias("doc_id")), "doc_id", "left_semi"), copies


def shingle_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different normalised texts whose similarity is 0.8 or more, and each further copy of a text with the
    first, at 1."""
    docs, copies = _firsts(spark, d)
    scratch = Scratch(spark, "jaccard")
    near = dedup.near_pairs(scratch.table(dedup.shingled(docs, PARAMS.ngrams), "sets"), PARAMS.threshold, scratch)
    return near.select("a", "b", F.round("similarity", 6).alias("similarity")).unionByName(copies.withColumn("similarity", F.lit(1.0)))


def minhash_dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    return dedup.minhash_clusters(_docs(spark, d), PARAMS)


def _minhash_sql() -> str:
    coefficients = ", ".join(f"({k}, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(PARAMS.coefficients()))
    return rf"""WITH RECURSIVE normal AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id, t FROM normal WHERE t <> '' GROUP BY t),
ab(k, a, b) AS (VALUES {coefficients}),
w AS (SELECT doc_id, t, string_split(t, ' ') AS words FROM SOURCE),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) ELSE [t] END) AS g FROM w)),
h AS (SELECT DISTINCT doc_id, (('0x' || substr(md5(g), 1, 8))::BIGINT % 2147483647) AS h FROM grams),
sig AS (SELECT doc_id, k, min((h * a + b) % 2147483647) AS m FROM h, ab GROUP BY doc_id, k)"""


def _bands_sql() -> str:
    return (
        _minhash_sql().replace("SOURCE", "firsts")
        + """, bands AS (SELECT doc_id, k // 10 AS band, string_agg(m::VARCHAR, ',' ORDER BY k) AS bucket FROM sig GROUP BY doc_id, k // 10),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a, b, count(*) AS c FROM pairs JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
near AS (SELECT a, b, c::DOUBLE / (x.n + y.n - c) AS similarity FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8)"""
    )


def html_text_regex(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select("page_id", html.html_text_plain(F.col("html")).alias("t")).select("page_id", _digest("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select("page_id", html.html_text("html").alias("text"))


def warc_wet_join(spark: SparkSession, d: str) -> DataFrame:
    """Own text of each page of a .warc archive beside the first 500 characters of the .wet archive's, joined on url."""
    responses, texts = _archives(spark, d)
    own = responses.select("url", html.html_text_plain(F.col("payload").cast("string")).alias("own"))
    other = texts.select("url", source.preview(F.col("payload").cast("string")).alias("preview"))
    return own.join(other, "url").select("url", F.length("own").cast("long").alias("own_length"), _digest("preview").alias("preview_md5"))


def _archives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Responses and conversions of pages, as read back from archives that were written of them."""
    scratch = Scratch(spark, "archive")
    pages = spread(table(spark, d, "pages"))
    rows = pages.select("url", F.lit("response").alias("warc_type"), F.encode("html", "UTF-8").alias("payload"))
    text = rows.withColumns({"warc_type": F.lit("conversion"), "payload": F.encode(html.html_text_plain(F.col("payload").cast("string")), "UTF-8")})
    warc.write_warc(rows, scratch.path("warc"))
    warc.write_warc(text, scratch.path("wet"), "none")
    return warc.read_warc(spark, scratch.path("warc")), warc.read_warc(spark, scratch.path("wet"), ("conversion",))


def warc_records(spark: SparkSession, d: str) -> DataFrame:
    """Every response and every conversion of the archives, by url."""
    responses, texts = _archives(spark, d)
    return responses.unionByName(texts).select("url", "warc_type", F.md5("payload").alias("payload_md5"), F.octet_length("payload").cast("long").alias("bytes"))


def warc_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose url occurs among those with an article in German."""
    pages = spread(table(spark, d, "pages"))
    return pages.join(pages.where(F.col("html").contains('lang="de"')).select("url"), "url", "left_semi").select("page_id")


_PLAIN_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))"""


def first_characters(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the first ten million characters."""
    return source.first_characters(_docs(spark, d), 10 * (1 << 20)).select("doc_id", F.length("text").cast("long").alias("n"))


def chunk_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Places at which each text can be cut into about 4 parts at ends of lines."""
    cut = source.chunk_boundaries(F.col("text"), 4, "\n")
    return _docs(spark, d).select("doc_id", F.array_join(cut.cast("array<string>"), ",").alias("boundaries"))


def classify_lang(spark: SparkSession, d: str) -> DataFrame:
    return classify.language(_docs(spark, d), _docs(spark, d))


def classify_quality(spark: SparkSession, d: str) -> DataFrame:
    return classify.quality(_docs(spark, d), table(spark, d, "labels"))


def classify_toxic(spark: SparkSession, d: str) -> DataFrame:
    return classify.toxic(_docs(spark, d), table(spark, d, "labels"))


def classify_nsfw(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", classify.nsfw(F.col("text")).alias("c"))
    return found.select("doc_id", "c.label", F.round("c.score", 6).alias("score"))


def curated_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Documents that pass all rules, masked, without repeated lines: how many and how long, by language."""
    docs = _docs(spark, d).where(gopher.passes(F.col("text")))
    clean = dedup.exact_lines(docs.select("doc_id", "lang", pii.mask_all(F.col("text")).alias("text")))
    return clean.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("characters"))


_any_nsfw = "(?i)\\b(?:" + "|".join(classify.NSFW_WORDS) + ")\\b"
QUERIES = {
    "pii_mask_emails": _masked("email"),
    "pii_mask_phones": _masked("phone"),
    "pii_mask_ips": _masked("ip"),
    "pii_mask_all": mask_all,
    "gopher_stats": gopher_stats,
    "gopher_filter": gopher_filter,
    **{f"gopher_{r}": _gopher(r) for r in _RULES},
    "line_frequency": line_frequency,
    "exact_line_dedup": exact_line_dedup,
    "exact_doc_dedup": exact_doc_dedup,
    "minhash_signature": minhash_signature,
    "lsh_candidates": lsh_candidates,
    "shingle_jaccard_pairs": shingle_jaccard_pairs,
    "minhash_dedup_survivors": minhash_dedup_survivors,
    "html_text_regex": html_text_regex,
    "html_text": html_text,
    "warc_wet_join": warc_wet_join,
    "warc_records": warc_records,
    "warc_semi_join": warc_semi_join,
    "first_characters": first_characters,
    "chunk_boundaries": chunk_boundaries,
    "classify_lang": classify_lang,
    "classify_quality": classify_quality,
    "classify_toxic": classify_toxic,
    "classify_nsfw": classify_nsfw,
    "curated_by_language": curated_by_language,
}

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM "
_DEDUP = "SELECT d.doc_id, coalesce(k.text, '') AS text FROM {0} d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM ({1}{0}) WHERE line IN (SELECT line FROM ({1}{0}) GROUP BY line HAVING count(*) = 1) GROUP BY doc_id) k ON d.doc_id = k.doc_id"
SQL = {
    "pii_mask_emails": _mask_sql("email"),
    "pii_mask_phones": _mask_sql("phone"),
    "pii_mask_ips": _mask_sql("ip"),
    "pii_mask_all": _mask_all_sql(),
    "gopher_stats": _GOPHER + "SELECT doc_id, n_words, round(mean_word_length, 6) AS mean_word_length, round(ellipsis_share, 6) AS ellipsis_share, round(alphabetic_share, 6) AS alphabetic_share FROM s",
    "gopher_filter": _GOPHER + "SELECT doc_id FROM s WHERE " + " AND ".join(_RULES.values()),
    **{f"gopher_{r}": _GOPHER + f"SELECT doc_id FROM s WHERE {rule}" for r, rule in _RULES.items()},
    "line_frequency": f"SELECT md5(line) AS line_md5, count(*) AS n FROM ({_LINES}documents) GROUP BY line",
    "exact_line_dedup": f"SELECT doc_id, md5(text) AS text_md5 FROM ({_DEDUP.format('documents', _LINES)})",
    "exact_doc_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text",
    "minhash_signature": _minhash_sql().replace("SOURCE", "(SELECT * FROM normal WHERE t <> '')") + " SELECT doc_id, md5(string_agg(m::VARCHAR, ',' ORDER BY k)) AS signature_md5 FROM sig GROUP BY doc_id",
    "lsh_candidates": _bands_sql() + " SELECT a, b FROM pairs UNION ALL SELECT f.doc_id, n.doc_id FROM normal n JOIN firsts f ON n.t = f.t AND n.doc_id <> f.doc_id",
    "shingle_jaccard_pairs": _bands_sql().split(", bands AS")[0]
    + """, sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON y.g = x.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)
SELECT a, b, round(c::DOUBLE / (x.n + y.n - c), 6) AS similarity FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8
UNION ALL SELECT f.doc_id, n.doc_id, 1.0::DOUBLE FROM normal n JOIN firsts f ON n.t = f.t AND n.doc_id <> f.doc_id""",
    "minhash_dedup_survivors": _bands_sql()
    + """, edges AS (SELECT a AS x, b AS y FROM near UNION SELECT b, a FROM near),
reach(x, y) AS (SELECT doc_id, doc_id FROM firsts UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x AS doc_id, min(y) AS cluster FROM reach GROUP BY x)
SELECT n.doc_id, coalesce(l.cluster, n.doc_id) AS cluster FROM normal n LEFT JOIN firsts f ON n.t = f.t LEFT JOIN least l ON l.doc_id = f.doc_id""",
    "html_text_regex": f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (SELECT page_id, {_PLAIN_SQL} AS t FROM pages)",
    "warc_wet_join": f"SELECT a.url, length(a.own)::BIGINT AS own_length, md5(substr(b.own, 1, 500)) AS preview_md5 FROM (SELECT url, {_PLAIN_SQL} AS own FROM pages) a JOIN (SELECT url, {_PLAIN_SQL} AS own FROM pages) b ON a.url = b.url",
    "warc_records": f"SELECT url, k AS warc_type, md5(t) AS payload_md5, octet_length(encode(t))::BIGINT AS bytes FROM (SELECT nullif(url, '') AS url, 'response' AS k, coalesce(html, '') AS t FROM pages UNION ALL SELECT nullif(url, ''), 'conversion', coalesce({_PLAIN_SQL}, '') FROM pages)",
    "warc_semi_join": """SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE html LIKE '%lang="de"%')""",
    "first_characters": "SELECT doc_id, least(length(text), 10485760 - at_)::BIGINT AS n FROM (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM documents) WHERE at_ < 10485760",
    "chunk_boundaries": """WITH g AS (SELECT doc_id, text, length(text) AS n, greatest(length(text) // 4, 1) AS step FROM documents),
c AS (SELECT doc_id, n, 0 AS p FROM g UNION SELECT doc_id, n, n FROM g UNION
    SELECT doc_id, n, CASE WHEN instr(substr(text, k * step + 1), chr(10)) > 0 THEN k * step + instr(substr(text, k * step + 1), chr(10)) - 1 ELSE n END FROM g, (VALUES (1), (2), (3)) t(k))
SELECT doc_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS boundaries FROM (SELECT DISTINCT doc_id, p FROM c) GROUP BY doc_id""",
    "classify_nsfw": f"SELECT doc_id, CASE WHEN h > 0 THEN 'nsfw' ELSE 'non-nsfw' END AS label, round(CASE WHEN h > 0 THEN 1 - exp(-h) ELSE 1.0 END, 6)::DOUBLE AS score FROM (SELECT doc_id, len(regexp_extract_all(text, {_quote(_any_nsfw)}))::DOUBLE AS h FROM documents)",
    "curated_by_language": _GOPHER
    + f", ok AS (SELECT doc_id FROM s WHERE {' AND '.join(_RULES.values())}), masked AS (SELECT doc_id, {_mask_all_sql().split('md5(', 1)[1].rsplit(') AS masked_md5', 1)[0]} AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM ok)), "
    + f"clean AS ({_DEDUP.format('masked', _LINES)}) SELECT lang, count(*) AS docs, sum(length(c.text))::BIGINT AS characters FROM clean c JOIN documents d ON c.doc_id = d.doc_id GROUP BY lang",
}
