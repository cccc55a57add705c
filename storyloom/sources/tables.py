"""The engine's tables, and views of the synthetic driver tables in their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import PUBLISHERS
from ..functions.markup import page_title
from ..functions.urls import classify, stable_id

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
ARTICLES = T.StructType(_text("id", "publisher_id", "original_url", "headline", "translated_headline", "snippet", "body_text", "image_url", "language", "published_at", "cluster_id", "category"))
CLUSTERS = T.StructType([*_text("id", "headline", "first_reported", "last_updated"), T.StructField("is_blindspot", T.BooleanType()), *_text("ai_headline", "ai_summary")])
CUSTOM_PUBLISHERS = T.StructType([*_text("id", "name", "rss_url", "scrape_method", "scrape_config"), T.StructField("is_global", T.BooleanType())])


def publishers(spark: SparkSession) -> DataFrame:
    """The nine fixed sources."""
    return spark.createDataFrame(PUBLISHERS, "id string, name string, bias_category string, language string, logo_url string, method string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as articles: id from the URL, headline from the title."""
    pages = table(spark, sf_dir, "pages")
    # The title is a column of its own first: it is searched for once, and the category reads it often.
    titled = pages.select("page_id", "url", "html", F.coalesce(page_title(F.col("html")), F.lit("")).alias("headline"))
    return titled.select("page_id", stable_id(F.col("url")).alias("id"), F.col("url").alias("original_url"), "headline", classify(F.col("url"), F.col("headline")).alias("category"), "html")


#: ``document_articles`` in SQL, for the oracles.
DOCUMENT_ARTICLES_SQL = """
pub AS (SELECT * FROM (VALUES (0, 'newsbook', 'church_owned'), (1, 'lovin_malta', 'commercial_independent'), (2, 'the_shift', 'investigative_independent'), (3, 'malta_today', 'commercial_independent'),
  (4, 'independent', 'commercial_independent'), (5, 'tvm_news', 'state_owned'), (6, 'one_news', 'party_owned_pl'), (7, 'net_news', 'party_owned_pn'), (8, 'times_of_malta', 'commercial_independent')) t(k, publisher_id, bias)),
art AS (SELECT doc_id, 'a' || doc_id AS id, publisher_id, bias, 'https://ex.com/' || source || '/' || doc_id AS original_url, left(split_part(text, chr(10), 1), 200) AS headline,
  CASE WHEN doc_id % 3 = 0 THEN 'T ' || split_part(text, chr(10), 1) ELSE '' END AS translated_headline, text AS snippet, text AS body_text,
  CASE WHEN doc_id % 5 = 0 THEN 'https://ex.com/i/' || doc_id || '.jpg' ELSE '' END AS image_url, CASE WHEN lang = 'en' THEN 'en' ELSE 'mt' END AS language,
  '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || 'T' || lpad((doc_id % 24)::VARCHAR, 2, '0') || ':' || lpad((doc_id % 60)::VARCHAR, 2, '0') || ':00+00:00' AS published_at,
  'c' || (doc_id // 8) AS cluster_id, CASE doc_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'politics' WHEN 2 THEN 'sport' ELSE 'crime' END AS category
  FROM documents JOIN pub ON k = substr(source, 4)::INT % 9)
"""


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles with synthetic keys: eight neighbouring documents are one story, ``src{k}`` is publisher k mod 9."""
    docs = table(spark, sf_dir, "documents")
    dim = spark.createDataFrame([(k, p[0], p[2]) for k, p in enumerate(PUBLISHERS)], "k int, publisher_id string, bias string")
    d, two = F.col("doc_id"), lambda c: F.lpad(c.cast("string"), 2, "0")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    published = F.concat(F.lit("2024-01-"), two(1 + d % 28), F.lit("T"), two(d % 24), F.lit(":"), two(d % 60), F.lit(":00+00:00"))
    category = F.element_at(F.array(*[F.lit(c) for c in ("general", "politics", "sport", "crime")]), (d % 4 + 1).cast("int"))
    rows = docs.withColumn("k", F.substring("source", 4, 9).cast("int") % 9).join(F.broadcast(dim), "k")  # nine rows
    return rows.select(
        "doc_id", F.concat(F.lit("a"), d).alias("id"), "publisher_id", "bias", F.concat(F.lit("https://ex.com/"), "source", F.lit("/"), d).alias("original_url"), F.left(first, F.lit(200)).alias("headline"),
        F.when(d % 3 == 0, F.concat(F.lit("T "), first)).otherwise("").alias("translated_headline"), F.col("text").alias("snippet"), F.col("text").alias("body_text"),
        F.when(d % 5 == 0, F.concat(F.lit("https://ex.com/i/"), d, F.lit(".jpg"))).otherwise("").alias("image_url"), F.when(F.col("lang") == "en", "en").otherwise("mt").alias("language"),
        published.alias("published_at"), F.concat(F.lit("c"), F.floor(d / 8)).alias("cluster_id"), category.alias("category"),
    )
