"""Word frequencies and sizes of stories kept as tables that changes are added to, instead of being counted anew.

``Counts`` holds three tables: in how many articles of a story a word stands (``story_words``), in how many stories it stands (``words``),
and how many articles a story has (``stories``).  A change of articles (new, moved, pruned) is a table of signed rows, one for each word that
an article brings to a story or takes from it; texts of other articles are not read.  A word's frequency among stories changes only where its
count in a story leaves zero or comes back to it, so only the changed pairs of story and word are looked up.  Signed rows add up
in any order and in any batches.  An article without a word counts for its story's size, but a story without words not for ``n_stories``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import STOP_WORDS
from ..functions.texts import idf, tokens
from ..intermediate import written


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, cluster_id, text, sign of what changes between two states of the changed articles, both with id, cluster_id, text; null or missing is no story."""
    rows = before.select("id", "cluster_id", "text", F.lit(-1).alias("sign")).unionByName(after.select("id", "cluster_id", "text", F.lit(1).alias("sign")))
    rows = rows.filter("cluster_id is not null").groupBy("id", "cluster_id", "text").agg(F.sum("sign").cast("int").alias("sign"))
    return rows.filter("sign <> 0")


def word_changes(changes: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """cluster_id, word, n: how much more often each word stands in articles of a story."""
    bags = F.array_distinct(F.transform(tokens(F.coalesce("text", F.lit("")), stop_words), lambda t: t["word"]))
    return changes.select("cluster_id", "sign", F.explode(bags).alias("word")).groupBy("cluster_id", "word").agg(F.sum("sign").cast("long").alias("n")).filter("n <> 0")


@dataclass
class Counts:
    """story_words: cluster_id, word, n; words: word, df; stories: cluster_id, size."""

    story_words: DataFrame
    words: DataFrame
    stories: DataFrame

    @classmethod
    def none(cls, like: DataFrame) -> "Counts":
        spark = like.sparkSession
        return cls(spark.createDataFrame([], "cluster_id string, word string, n long"), spark.createDataFrame([], "word string, df long"), spark.createDataFrame([], "cluster_id string, size long"))

    def add(self, changes: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> "Counts":
        """The counts after ``changes`` (see ``signed``)."""
        changes = written(changes)  # read for words and for sizes
        moved = written(word_changes(changes, stop_words))
        touched = self.story_words.join(moved.select("cluster_id", "word"), ["cluster_id", "word"], "left_semi").withColumnRenamed("n", "had")
        pairs = written(moved.join(touched, ["cluster_id", "word"], "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("has", F.col("had") + F.col("n")))
        step = F.when((F.col("had") == 0) & (F.col("has") > 0), 1).when((F.col("had") > 0) & (F.col("has") == 0), -1)
        frequency = pairs.withColumn("step", step).filter("step is not null").groupBy("word").agg(F.sum("step").alias("df")).filter("df <> 0")
        rest = self.story_words.join(pairs.select("cluster_id", "word"), ["cluster_id", "word"], "left_anti")
        sizes = changes.groupBy("cluster_id").agg(F.sum("sign").alias("size"))
        return Counts(
            rest.unionByName(pairs.filter("has > 0").select("cluster_id", "word", F.col("has").alias("n"))),
            _added(self.words, frequency, "word", "df"),
            _added(self.stories, sizes, "cluster_id", "size"),
        )

    def kept(self) -> "Counts":
        """The same, written: what the next change is added to."""
        return Counts(written(self.story_words), written(self.words), written(self.stories))

    def idf_table(self) -> DataFrame:
        """word, df, idf among the stories that have words."""
        n = self.story_words.agg(F.countDistinct("cluster_id").alias("n"))
        return self.words.select("word", "df", idf(n.scalar(), F.col("df")).alias("idf"))


def _added(table: DataFrame, more: DataFrame, key: str, value: str) -> DataFrame:
    """The sums of both by key; keys whose sum is 0 go."""
    return table.unionByName(more.select(key, F.col(value).cast("long").alias(value))).groupBy(key).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def counted(articles: DataFrame, text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Counts:
    """The counts of a whole table of articles, written: its texts are read once, by the words' shuffle only."""
    rows = articles.filter("cluster_id is not null").select("cluster_id", F.coalesce(text, F.lit("")).alias("text"), F.lit(1).alias("sign"))
    story_words = written(word_changes(rows, stop_words))
    words = written(story_words.groupBy("word").agg(F.count("*").alias("df")))
    return Counts(story_words, words, written(rows.groupBy("cluster_id").agg(F.count("*").alias("size"))))
