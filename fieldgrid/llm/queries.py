"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, codes, language, licenses, media, mixing, neardup, quality, tokens, trie, urls
from .common import cut, fold, table

RANKS = "byte_bpe_50k.tiktoken"
#: The id that the vocabulary leaves free ends documents in token files.
END_OF_DOCUMENT = 50_256
#: Documents that may be learnt from, as conditions on doc_id.
QUALITY_FOLD = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"
LANGUAGE_FOLD = "crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"
#: Score from which a document counts as good.
GOOD = 0.3


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), QUALITY_FOLD, cut_at=GOOD)
    scored = quality.with_score(docs, model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cut(tokens.token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_DOCUMENT))
    return tokens.scan(blocks, END_OF_DOCUMENT, labels="doc_ids").withColumnRenamed("label", "doc_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), templates=licenses.TEMPLATES + licenses.WHOLE, block_words=None)
    return docs.select("doc_id", *(f"license.{k}" for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "released", "due", "within", "chars")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_packs(said.unionByName(more)))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select("doc_id", "bpe.*")


def op9_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_stored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, LANGUAGE_FOLD)
    labelled = language.with_language(docs.select("doc_id", "text"), model)
    return labelled.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
        F.size("language.span_langs").cast("long").alias("n_spans"),
    )


#: Rules of the URL filter.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.with_verdict(pages, rules, urls.fit(urls.labelled_urls(spark))).select("page_id", "judged.*")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, book = codes.codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = F.lit(book.digest() if book else "")
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_ALL = (
    op1_quality_classifier, op2_token_counts, op3_simhash_near_dedup, op4_license_scan, op5_source_mixing,
    op6_chat_formatting, op7_nearest_neighbours, op8_byte_bpe, op9_media_sniffing, op10_language_id,
    op11_url_filter, op12_vector_codes, op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _escaped(column: str) -> str:
    """SQL that puts a backslash behind the first character of each control string."""
    rests = "|".join(re.escape(c[1:]) for c in sorted(chat.CONTROLS, key=len, reverse=True))
    return rf"regexp_replace({column}, '([<\[])(\\*(?:{rests}))', '\1\\\2', 'g')"


def _assigned(k: int) -> str:
    """SQL of each part's nearest entry of codebook ``k``."""
    square = "list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""at{k} AS (
  SELECT vec_id, label, part, v, m.entry, m.d FROM (
    SELECT c.vec_id, c.label, c.part, c.v, min({{'d': {square}, 'entry': b.entry}}) AS m FROM cut_ c JOIN book{k} b USING (part) GROUP BY ALL))"""


def _round(k: int, to: int) -> str:
    """SQL of codebook ``to``, the means of the parts that codebook ``k`` is nearest to."""
    return f"""{_assigned(k)}, sums{to} AS (
  SELECT part, entry, i, sum(v[i]) AS total, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM at{k}) GROUP BY ALL
), book{to} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM sums{to} GROUP BY ALL) m USING (part, entry))"""


ORACLES: dict[str, str] = {
    "op6_chat_formatting": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text) AS loss,
    sum({len(chat.TURN + chat.SAYS + chat.OVER)} + length({_escaped("role")}) + length({_escaped("text")})) AS chars
  FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
""",
    "op12_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut_ AS (
  SELECT vec_id, label, part, list_slice(ints, part * (len(ints) // 16) + 1, (part + 1) * (len(ints) // 16)) AS v FROM kept, range(16) AS p(part)
), book0 AS (
  SELECT part, entry, v FROM cut_ JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), {_round(0, 1)}, {_round(1, 2)}, {_assigned(2)}, coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM at2 GROUP BY ALL
), book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
""",
    "op13_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, list(said ORDER BY place) AS turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x))),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h
  FROM own GROUP BY c
), whole AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100
), met AS (
  SELECT c, d, turns[1:d] AS path, turns[1:d - 1] AS above, len(turns) AS n, coalesce(length(turns[d].text), 0) AS tokens FROM whole, range(0, 1000000) AS r(d) WHERE d <= len(turns)
), node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN above END) AS above, (count(*) - 1) * any_value(tokens) AS saved,
    sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM met GROUP BY path, d
), kids AS (SELECT above AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY above
), sums AS (
  SELECT v.path, sum(u.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM node v JOIN node u ON u.d >= v.d AND u.path[1:v.d] = v.path LEFT JOIN kids k ON k.path = u.path GROUP BY v.path
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v JOIN sums s ON s.path = v.path LEFT JOIN kids k ON k.path = v.path LEFT JOIN node p ON v.d > 0 AND p.d = v.d - 1 AND p.path = v.above
""",
}
