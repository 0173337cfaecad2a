"""Queries on tokens: pre-tokens, BPE, special tokens, windows, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bpe, windows
from millrace.scratch import Scratch
from millrace.session import spread, table
from millrace.sources import tokens as token_source
from millrace.streaming import encode as streaming

VOCAB = 10_000
SPECIALS = [tx.END_OF_TEXT]
TOP_K, TOP_P, TEMPERATURE = 50, 0.9, 0.7


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.word_counts(_docs(spark, d)).select(F.hex(F.encode("word", "UTF-8")).alias("word_hex"), "n")


def pretoken_per_lang(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang").agg(F.sum(F.size(tx.pretokens(F.col("text")))).cast("long").alias("n"))


def pair_counts_bytes(spark: SparkSession, d: str) -> DataFrame:
    return bpe.pair_counts(bpe.word_counts(_docs(spark, d)))


def bpe_first_merge(spark: SparkSession, d: str) -> DataFrame:
    return bpe.first_merge(pair_counts_bytes(spark, d))


#: Vocabularies of this application's tables, saved where all executors can read them.
_saved: dict[tuple[str, str], str] = {}


def _trained(spark: SparkSession, d: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    """The vocabulary of all documents: trained once an application, then read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _saved:
        path = Scratch(spark, "vocabulary").path("saved")
        token_source.write_vocabulary(spark, path, *bpe.train(_docs(spark, d), VOCAB, SPECIALS))
        _saved[key] = path
    return token_source.read_vocabulary(spark, _saved[key])


def bpe_train(spark: SparkSession, d: str) -> DataFrame:
    """rank, left, right (hex) of the merges learned from all documents."""
    _saved.pop((spark.sparkContext.applicationId, d), None)  # this query always trains
    _, merges = _trained(spark, d)
    rows = [(k, a.hex().upper(), b.hex().upper()) for k, (a, b) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank long, left string, right string")


def _codec(spark: SparkSession, d: str) -> bpe.Codec:
    return bpe.Codec(*_trained(spark, d), SPECIALS)


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", bpe.encoder(_codec(spark, d))(F.col("text")).alias("ids"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def bpe_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text as it comes back from its ids."""
    codec = _codec(spark, d)
    ids = _docs(spark, d).select("doc_id", bpe.encoder(codec)(F.col("text")).alias("ids"))
    back = ids.select("doc_id", bpe.decoder(codec)(F.col("ids")).alias("text"))
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def token_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text as it comes back from a table of two-byte ids."""
    codec = _codec(spark, d)
    path = Scratch(spark, "tokens").path("ids")
    token_source.write_token_table(_docs(spark, d).select("doc_id", bpe.encoder(codec)(F.col("text")).alias("ids")), path)
    back = token_source.read_token_table(spark, path).select("doc_id", bpe.decoder(codec)(F.col("ids")).alias("text"))
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def special_token_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a special token for each end of line, split at it and counted."""
    joined = F.regexp_replace("text", "\n", SPECIALS[0])
    parts = tx.split_special(joined, SPECIALS)
    found = _docs(spark, d).select("doc_id", F.explode(parts).alias("part"))
    special = F.col("part") == SPECIALS[0]
    return found.groupBy("doc_id").agg(F.count_if(special).alias("specials"), F.count_if(~special).alias("parts"), F.sum(F.when(special, 0).otherwise(F.length("part"))).cast("long").alias("characters"))


def byte_unicode_map(spark: SparkSession, d: str) -> DataFrame:
    rows = [(b, ord(s)) for b, s in tx.byte_signs().items()]
    return spark.createDataFrame(rows, "byte long, code long")


def next_token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How often each word follows each other within a document."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    pairs = _docs(spark, d).select(F.explode(windows.next_tokens(words)).alias("p"))
    # words are shorter than their digests, and alike, so it's they that are shuffled
    counted = pairs.groupBy("p.x", "p.y").agg(F.count("*").alias("n"))
    return counted.select(F.md5(F.encode("x", "UTF-8")).alias("x_md5"), F.md5(F.encode("y", "UTF-8")).alias("y_md5"), "n")


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 64 words at every 64th, with the words moved on by one."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    found = _docs(spark, d).select("doc_id", F.explode(windows.context_windows(words, 64, 64)).alias("w"))
    digest = lambda c: F.md5(F.encode(F.array_join(c, " "), "UTF-8"))
    return found.select("doc_id", F.col("w.start").cast("long").alias("start"), digest("w.x").alias("x_md5"), digest("w.y").alias("y_md5"))


def _unigrams(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return _docs(spark, d).select(F.explode(words).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select(F.md5(F.encode("item", "UTF-8")).alias("item_md5"), F.round("p", 8).alias("p"))


def top_k_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _digested(windows.top_k(windows.distribution(_unigrams(spark, d)), TOP_K))


def top_p_nucleus(spark: SparkSession, d: str) -> DataFrame:
    """Size and mass of the nucleus, and its least likely item."""
    found = windows.top_p(windows.distribution(_unigrams(spark, d)), TOP_P)
    return found.agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"), F.round(F.min("p"), 8).alias("least"))


def temperature_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _digested(windows.distribution(_unigrams(spark, d), TEMPERATURE))


def stream_encode(spark: SparkSession, d: str) -> DataFrame:
    """All documents encoded as a stream of files."""
    codec, scratch = _codec(spark, d), Scratch(spark, "stream")
    scratch.table(_docs(spark, d).select("doc_id", "text"), "in")
    found = streaming.encode_folder(spark, scratch.path("in"), codec, scratch.path("out"), scratch.path("state"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        pretoken_counts, pretoken_per_lang, pair_counts_bytes, bpe_first_merge, bpe_train, bpe_encode, bpe_decode_roundtrip,
        token_table_roundtrip, special_token_split, byte_unicode_map, next_token_pairs, context_windows, top_k_tokens,
        top_p_nucleus, temperature_softmax, stream_encode,
    )
}

# Unicode white space, since RE2's \s is ASCII; U+0001 goes before the last space of a run in place of
# the look-ahead that RE2 lacks
_W = r"\t\n\x0b\f\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PRETOKENS = (
    f"regexp_extract_all(regexp_replace(text, '([{_W}])([^{_W}])', chr(1) || '\\1\\2', 'g'), "
    rf"'''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}\x01]+|[{_W}]+')"
)
_WORDS = rf"WITH p AS (SELECT unnest({_PRETOKENS}) AS word FROM documents), c AS (SELECT hex(encode(word)) AS h, count(*) AS n FROM p GROUP BY word)"
_PAIRS = _WORDS + ", g AS (SELECT substr(h, 2 * i - 1, 2) AS \"left\", substr(h, 2 * i + 1, 2) AS \"right\", n FROM (SELECT h, n, unnest(range(1, length(h) // 2)) AS i FROM c)), b AS (SELECT \"left\", \"right\", sum(n)::BIGINT AS n FROM g GROUP BY ALL)"
_SPLIT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_UNIGRAMS = f"WITH u AS (SELECT item, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS item FROM documents) GROUP BY item), p AS (SELECT item, n::DOUBLE / sum(n) OVER () AS p FROM u)"
SQL = {
    "pretoken_counts": _WORDS + " SELECT h AS word_hex, n FROM c",
    "pretoken_per_lang": f"SELECT lang, sum(len({_PRETOKENS}))::BIGINT AS n FROM documents GROUP BY lang",
    "pair_counts_bytes": _PAIRS + ' SELECT "left", "right", n FROM b',
    "bpe_first_merge": _PAIRS + ' SELECT "left", "right", n FROM b ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1',
    "bpe_decode_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "token_table_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "special_token_split": "SELECT doc_id, (len(text) - len(replace(text, chr(10), '')))::BIGINT AS specials, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))::BIGINT AS parts, len(replace(text, chr(10), ''))::BIGINT AS characters FROM documents WHERE text <> ''",
    "byte_unicode_map": "WITH b AS (SELECT range AS byte, (range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range >= 174) AS shown FROM range(256)) SELECT byte::BIGINT AS byte, CASE WHEN shown THEN byte ELSE 255 + sum(CASE WHEN shown THEN 0 ELSE 1 END) OVER (ORDER BY byte) END::BIGINT AS code FROM b",
    "next_token_pairs": f"WITH w AS (SELECT {_SPLIT} AS w FROM documents), p AS (SELECT w, unnest(range(1, len(w))) AS i FROM w) SELECT md5(w[i]) AS x_md5, md5(w[i + 1]) AS y_md5, count(*) AS n FROM p GROUP BY w[i], w[i + 1]",
    "context_windows": f"WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w) - 64, 64)) AS start FROM w) SELECT doc_id, start::BIGINT AS start, md5(array_to_string(w[start + 1:start + 64], ' ')) AS x_md5, md5(array_to_string(w[start + 2:start + 65], ' ')) AS y_md5 FROM s",
    "top_k_tokens": f"""WITH words AS (SELECT unnest({_SPLIT}) AS item FROM documents), counted AS MATERIALIZED (SELECT item, count(*) AS n FROM words GROUP BY item),
ranked AS (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS place FROM counted), last AS (SELECT min(n) AS n FROM ranked WHERE place <= {TOP_K})
SELECT md5(c.item) AS item_md5, round(c.n::DOUBLE / (SELECT sum(n)::DOUBLE FROM counted), 8) AS p FROM counted c, last WHERE c.n >= last.n""",
    "top_p_nucleus": _UNIGRAMS
    + f", o AS (SELECT item, p, coalesce(sum(p) OVER (ORDER BY p DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), k AS (SELECT p FROM o WHERE before <= {TOP_P}) SELECT count(*) AS n, round(sum(p) / (SELECT sum(p) FROM k), 6) AS mass, round(min(p) / (SELECT sum(p) FROM k), 8) AS least FROM k",
    "temperature_softmax": _UNIGRAMS + f" SELECT md5(item) AS item_md5, round(n ** (1 / {TEMPERATURE}) / sum(n ** (1 / {TEMPERATURE})) OVER (), 8) AS p FROM u",
}
