"""The operators of this subpackage as queries on whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.llm import (
    brown_lm, byte_bpe, collocations, conversation_repair, embedding_dedup, harmonic_packing, html_extract, near_dedup, packing, quality_gam, quality_rules,
    substring_dedup, url_filter,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_best_fit_packing(spark, sf):
    docs = table(spark, sf, "documents")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), keep_ids=False)


@query()
def op2_byte_bpe(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents")
    return byte_bpe.round_trip_digests(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op5_url_filter(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, url_filter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query(quality_rules.oracle_sql())
def op9_quality_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text")).drop("text", "clean_text")


def crc_mod(n: int):
    """crc32 of the document number as text, modulo n; a null number counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query()
def op10_brown_lm(spark, sf):
    return brown_lm.score_documents(table(spark, sf, "documents"), crc_mod(7) != 2)


GOOD_FROM = 0.3


@query()
def op3_quality_gam(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality_gam.score_documents(docs, labels, crc_mod(5) != 0)
    return scored.select(
        "doc_id", (crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )


@query("""
WITH RECURSIVE l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a, embeddings b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.x
""")
def op7_embedding_dedup(spark, sf):
    return embedding_dedup.deduplicate(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query()
def op6_html_extract(spark, sf):
    return html_extract.extract(table(spark, sf, "pages"))


@query()
def op4_near_dedup(spark, sf):
    return near_dedup.deduplicate(table(spark, sf, "documents").select("doc_id", "text"))


@query()
def op8_substring_dedup(spark, sf):
    return substring_dedup.duplicate_passages(table(spark, sf, "documents").select("doc_id", "text"))


@query()
def op11_harmonic_packing(spark, sf):
    docs = table(spark, sf, "documents")
    return harmonic_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), keep_ids=False)


@query()
def op13_conversation_repair(spark, sf):
    return conversation_repair.damage_and_repair(table(spark, sf, "conversations"))


@query("""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda s: array_to_string(ws[s:s + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)
),
c AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
parts AS (
  SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS tail
  FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
),
cuts AS (
  SELECT x.lang, x.phrase, x.a, k, h.a AS l, t.a AS r, (2000000::HUGEINT * x.a) // (h.a + t.a) AS score
  FROM parts x JOIN c h ON x.lang = h.lang AND x.head = h.phrase JOIN c t ON x.lang = t.lang AND x.tail = t.phrase
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (
  SELECT lang, a, unnest(list_transform(range(1, m - j + 2), lambda s: array_to_string(string_split(phrase, ' ')[s:s + j - 1], ' '))) AS phrase
  FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < m
),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_runs GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN around o ON b.lang = o.lang AND b.phrase = o.phrase
  WHERE o.most IS NULL OR 100 * o.most < 80 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op12_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))
