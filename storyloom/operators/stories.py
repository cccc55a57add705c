"""Roll-ups of articles to stories and the views that readers get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import BIAS_CATEGORIES, DEFAULT_BIAS, INDEPENDENT
from ..functions.texts import shuffle_score, source_score


def feed(clusters: DataFrame, articles: DataFrame, blindspots_only: bool = False) -> DataFrame:
    """Stories with their articles nested by time, newest story first."""
    c = clusters.filter("is_blindspot") if blindspots_only else clusters
    fields = [f for f in articles.columns if f != "cluster_id"]
    nested = articles.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("published_at", *[f for f in fields if f != "published_at"]))).alias("articles"))
    return c.join(nested, c["id"] == nested["cluster_id"]).drop("cluster_id").orderBy(F.desc("last_updated"), "id")


def cluster_publishers(articles: DataFrame) -> DataFrame:
    """Latest time and publishers of each story."""
    return articles.filter("cluster_id is not null").groupBy("cluster_id").agg(F.max("published_at").alias("last_published"), F.array_sort(F.collect_set(F.nullif("publisher_id", F.lit("")))).alias("publishers"))


def dominant_category(articles: DataFrame, by: str = "cluster_id") -> DataFrame:
    """The only category, else the most frequent with two votes at least, else general; the smaller name on a tie."""
    n = articles.groupBy(by, "category").agg(F.count("*").alias("n"))
    top = n.groupBy(by).agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("t"))
    return top.select(by, F.when((F.col("kinds") == 1) | (F.col("most") >= 2), F.col("t.category")).otherwise("general").alias("category"))


def blindspot(articles: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Stories that known sources cover but no independent one; column bias is null for unknown sources."""
    known = F.count("bias") > 0
    return articles.groupBy(by).agg((known & ~F.coalesce(F.bool_or(F.col("bias").isin(INDEPENDENT)), F.lit(False))).alias("is_blindspot"))


def with_overrides(bias: Column, publisher: Column, overrides: dict[str, str]) -> Column:
    """The reader's own view of a source, where there is one."""
    if not overrides:
        return bias
    table = F.create_map(*[F.lit(x) for pair in sorted(overrides.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, publisher), bias)


def blindspot_with_overrides(articles: DataFrame, overrides: dict[str, str], by: str = "cluster_id") -> DataFrame:
    """As readers see it: unknown sources count as commercial and independent."""
    bias = with_overrides(F.coalesce("bias", F.lit(DEFAULT_BIAS)), F.col("publisher_id"), overrides)
    return articles.groupBy(by).agg((~F.bool_or(bias.isin(INDEPENDENT))).alias("is_blindspot"))


def best_headline(articles: DataFrame, headline: Column, by: str = "cluster_id") -> DataFrame:
    """The headline of the best source, the longest of those, the last of those by time and id."""
    rank = F.struct(source_score(F.col("bias")).alias("s"), F.octet_length(headline).alias("l"), F.col("published_at").alias("t"), F.col("id").alias("i"))
    return articles.groupBy(by).agg(F.max_by(headline, rank).alias("headline"))


def bias_coverage(articles: DataFrame, bias: Column, by: str = "cluster_id") -> DataFrame:
    """Whole percentages of the nine ownership categories that add up to 100 by largest remainders; unknown ones count in the total only."""
    counts = articles.groupBy(by).agg(F.count("*").alias("total_articles"), *[F.count_if(bias == c).alias(f"n_{c}") for c in BIAS_CATEGORIES])
    exact = F.array(*[F.col(f"n_{c}") / F.col("total_articles") * 100 for c in BIAS_CATEGORIES])
    rows = counts.withColumn("e", exact).withColumn("f", F.transform("e", lambda x: F.floor(x)))
    order = F.transform(F.array_sort(F.transform("e", lambda x, i: F.struct((-(x - F.floor(x))).alias("d"), i.alias("i")))), lambda s: s["i"])
    rows = rows.withColumn("up", F.slice(order, F.lit(1), (100 - F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("int")))
    pct = lambda i: (F.element_at("f", i + 1) + F.array_contains("up", i).cast("int")).cast("int")
    return rows.select(by, *[pct(i).alias(c) for i, c in enumerate(BIAS_CATEGORIES)], F.col("total_articles"))


def segments(coverage: DataFrame, by: str = "cluster_id") -> DataFrame:
    """The categories with a share, largest first, in the fixed order on ties."""
    rows = F.array(*[F.struct((-F.col(c)).alias("m"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(BIAS_CATEGORIES)])
    return coverage.select(by, F.explode(F.filter(F.array_sort(rows), lambda r: r["m"] < 0)).alias("r")).select(by, F.col("r.c").alias("category"), (-F.col("r.m")).alias("percentage"))


def by_publisher(articles: DataFrame, visible: int = 4, by: str = "cluster_id") -> DataFrame:
    """Publishers of a story in order of appearance; how many lie beyond the visible ones."""
    first = articles.groupBy(by, "publisher_id").agg(F.min(F.struct("published_at", "id")).alias("at"), F.count("*").alias("n"))
    rows = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "publisher_id", "n"))).alias("p"))
    return rows.select(by, F.array_join(F.transform(F.slice("p", 1, visible), lambda x: x["publisher_id"]), ",").alias("visible"), F.greatest(F.lit(0), F.size("p") - visible).alias("overflow"))


def majority_language(articles: DataFrame, by: str = "cluster_id") -> DataFrame:
    """mt if more than half of the articles are, else en."""
    return articles.groupBy(by).agg(F.when(F.count_if(F.col("language") == "mt") * 2 > F.count("*"), "mt").otherwise("en").alias("language"))


def first_with(articles: DataFrame, value: str, keep: Column, name: str, by: str = "cluster_id") -> DataFrame:
    """The value of the first article by time that fulfils a condition; null if none does."""
    return articles.groupBy(by).agg(F.min_by(value, F.when(keep, F.struct("published_at", "id"))).alias(name))


def timeline(articles: DataFrame, by: str = "cluster_id") -> DataFrame:
    """Articles of each story by time; the first broke the story."""
    w = Window.partitionBy(by).orderBy("published_at", "id")
    return articles.select(by, "id", "published_at", F.row_number().over(w).alias("position")).withColumn("broke_story", F.col("position") == 1)


def shuffled(stories: DataFrame, key: int) -> DataFrame:
    """id, n_articles, score: larger stories first, mixed by a reproducible chance."""
    return stories.withColumn("score", shuffle_score(F.col("id"), key, F.col("n_articles")))


def local_feed(articles: DataFrame, is_global: Column, wanted_global: bool, disabled: list[str]) -> DataFrame:
    """Articles of one tab without the sources that are turned off; stories left empty are gone."""
    return articles.filter((is_global == wanted_global) & ~F.col("publisher_id").isin(disabled or [""]))


def stories_with_category(articles: DataFrame, category: str) -> DataFrame:
    """All articles of the stories in which any article has the category."""
    return articles.join(articles.filter(F.col("category") == category).select("cluster_id").distinct(), "cluster_id", "left_semi")
