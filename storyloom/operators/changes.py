"""Table changes as transformations: each takes tables and returns the table after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .conflicts import first_come, last_come


def existing_ids(wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """Those of the wanted ids that are stored."""
    return wanted.select("id").distinct().join(articles.select("id"), "id", "left_semi")


def new_articles(articles: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """The rows that are added when they come one by one in their order, each if its id and its URL are both new by then and required fields are there."""
    rows = new.filter("id is not null and original_url is not null and publisher_id is not null and headline is not null and published_at is not null")
    rows = rows.join(articles.select("id"), "id", "left_anti").join(articles.select("original_url"), "original_url", "left_anti")
    return first_come(rows.select(*new.columns), ["id", "original_url"], *order)


def insert_articles(articles: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """The table with its new articles."""
    return articles.unionByName(new_articles(articles, new, *order).select(*articles.columns))


def set_value(articles: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """values: id and the column's new value."""
    new = values.select("id", F.col(column).alias("__new"))
    return articles.join(new, "id", "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*articles.columns)


def upsert_clusters(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts stories; existing ones get headline, flag and the later last_updated, and keep first_reported and their summary."""
    o, n = clusters.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    old = F.col("o.id").isNotNull()
    take = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(take("id"), take("headline"), keep("first_reported"), F.greatest("o.last_updated", "n.last_updated").alias("last_updated"), take("is_blindspot"), keep("ai_headline"), keep("ai_summary"))


def prune(articles: DataFrame, clusters: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Articles from the cutoff on, compared as text, and the stories that still have some."""
    kept = articles.filter(F.col("published_at") >= cutoff)
    return kept, orphans_gone(kept, clusters)


def orphans_gone(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Stories that have an article."""
    return clusters.join(articles.filter("cluster_id is not null").select(F.col("cluster_id").alias("id")).distinct(), "id", "left_semi")


def split_article(articles: DataFrame, clusters: DataFrame, article_id: str, new_id: str) -> tuple[DataFrame, DataFrame]:
    """Moves one article to a story of its own; stories left empty go."""
    mine = articles.filter(F.col("id") == article_id)
    story = mine.select(F.lit(new_id).alias("id"), "headline", F.col("published_at").alias("first_reported"), F.col("published_at").alias("last_updated"), F.lit(False).alias("is_blindspot"), F.lit("").alias("ai_headline"), F.lit("").alias("ai_summary"))
    moved = articles.withColumn("cluster_id", F.when(F.col("id") == article_id, new_id).otherwise(F.col("cluster_id")))
    story = story.join(clusters.select("id"), "id", "left_anti")
    return moved, orphans_gone(moved, clusters.unionByName(story.select(*clusters.columns)))


def merge_clusters(articles: DataFrame, clusters: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """merges: from_id, to_id (resolved) -> articles moved, merged stories gone."""
    m = merges.select(F.col("from_id").alias("cluster_id"), "to_id")
    moved = articles.join(m, "cluster_id", "left").withColumn("cluster_id", F.coalesce("to_id", "cluster_id")).select(*articles.columns)
    return moved, clusters.join(merges.select(F.col("from_id").alias("id")), "id", "left_anti")


def wipe_clusters(articles: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No stories, all articles kept."""
    return articles.withColumn("cluster_id", F.lit(None).cast("string")), clusters.limit(0)


def wipe_all(articles: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nothing left."""
    return articles.limit(0), clusters.limit(0)


def upsert_publisher(custom: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """Adds sources one by one in their order, each in place of those that share its id or its address."""
    rows = custom.join(new.select("id"), "id", "left_anti").join(new.select("rss_url"), "rss_url", "left_anti")
    return rows.select(*custom.columns).unionByName(last_come(new, ["id", "rss_url"], *order).select(*custom.columns))


def delete_publisher(custom: DataFrame, articles: DataFrame, publisher_id: str) -> tuple[DataFrame, DataFrame]:
    """The source and its articles; stories are not pruned here."""
    return custom.filter(F.col("id") != publisher_id), articles.filter(F.col("publisher_id") != publisher_id)


def cache_body(articles: DataFrame, fetched: DataFrame) -> DataFrame:
    """fetched: id, body_text, image_url; bodies that are there are kept, images fill empty ones only."""
    f = fetched.select("id", F.col("body_text").alias("__b"), F.col("image_url").alias("__i"))
    fill = lambda c, new: F.coalesce(F.nullif(c, F.lit("")), F.nullif(F.col(new), F.lit("")), F.lit(""))
    return articles.join(f, "id", "left").withColumn("body_text", fill("body_text", "__b")).withColumn("image_url", fill("image_url", "__i")).select(*articles.columns)


def cache_summary(clusters: DataFrame, summaries: DataFrame) -> DataFrame:
    """summaries: id, ai_headline, ai_summary."""
    s = summaries.select("id", F.col("ai_headline").alias("__h"), F.col("ai_summary").alias("__s"))
    return clusters.join(s, "id", "left").withColumn("ai_headline", F.coalesce("__h", "ai_headline")).withColumn("ai_summary", F.coalesce("__s", "ai_summary")).select(*clusters.columns)


def translated_or_marked(articles: DataFrame, stored: DataFrame, translate: Column | None = None) -> DataFrame:
    """Maltese headlines of new articles go through ``translate`` (identity offline); stored ones are marked by their own headline."""
    known = stored.select("id", F.lit(True).alias("__known"))
    new = F.when((F.col("language") == "mt") & (F.col("translated_headline") == ""), translate if translate is not None else F.col("headline")).otherwise(F.col("translated_headline"))
    return articles.join(known, "id", "left").withColumn("translated_headline", F.when(F.col("__known"), F.col("headline")).otherwise(new)).select(*articles.columns)
