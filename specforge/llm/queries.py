"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm import (alignment, byte_bpe, chat, exact, html_text, mixing, phrases, quality_lines, simhash,
                           token_files, toxicity, url_rules, vector_graph)
from specforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return register if fn is None else register(fn)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which every executor has installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, tokenizer("word_bpe_49k.json"), end_id=1)


@query(sql="""
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.v FROM reach r JOIN pairs p ON p.u = r.other)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.u = e.vec_id) AS n_links,
  (SELECT min(other) FROM reach r WHERE r.id = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(other) FROM reach r WHERE r.id = e.vec_id) AS kept
FROM embeddings e""")
def op2_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return vector_graph.cluster(table(spark, folder, "embeddings"))


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.cluster(table(spark, folder, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, folder, "documents")
    return byte_bpe.digests(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


@query(sql="""
WITH c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10)
    || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS chat
  FROM conversations GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat FROM c GROUP BY n_turns, chat)
SELECT conv_id, n_turns, n_copies, chat FROM k
WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.n_turns > k.n_turns AND starts_with(b.chat, k.chat))""")
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.decide(table(spark, folder, "documents"))


@query
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"), keep=["page_id"])


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(sql=f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
hits AS (
  SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM hits WHERE place = 1""")
def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_quality_lines(spark: SparkSession, folder: str) -> DataFrame:
    return quality_lines.judge(table(spark, folder, "documents"))


@query(sql="""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w = 1 AS kept FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g""")
def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.deduplicate(table(spark, folder, "documents"))


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query(sql=f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
rows AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM rows),
grams AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, s FROM starts, range(1, 6) r(s) WHERE i + s - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, p, s, count(*) AS f FROM grams GROUP BY lang, p, s HAVING s = 1 OR count(*) >= 100),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
wide AS (SELECT lang, p, s, f, string_split(p, ' ') AS w FROM f WHERE s >= 2),
inner_parts AS (
  SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS p FROM wide, range(1, 5) a(i), range(2, 5) b(m)
  WHERE m < s AND i + m - 1 <= s),
kept AS (SELECT * FROM wide c WHERE NOT EXISTS (
  SELECT 1 FROM inner_parts b WHERE b.lang = c.lang AND b.p = c.p AND 100 * b.f >= 100 * c.f)),
parts AS (
  SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM kept, range(1, 5) x(k) WHERE k < s),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM parts c JOIN total USING (lang) JOIN f l ON l.lang = c.lang AND l.p = head JOIN f r ON r.lang = c.lang AND r.p = tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS cut FROM cuts),
placed AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank,
    p AS phrase, a, l, r, n, score::BIGINT AS score FROM best WHERE cut = 1)
SELECT * FROM placed WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
