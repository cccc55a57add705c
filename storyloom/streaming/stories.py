"""Stories as keyed state: each story's live articles, with timers for their retention and for stories that nothing updates.

The watermark trails the newest article by the retention period, so it is the oldest time that still counts: an article that it has
passed is expired, whether it was kept or comes late, and the clock of all timers is the watermark plus the period.  A batch
touches the stories of its own articles and those whose timers are due; no story is read or written for another's sake.  The rows
that come out are the changes: the last row of a story is what it is now.  They do not depend on the order in which articles arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import RETENTION_DAYS, STALE_HOURS

_HOUR = 3_600_000
RETENTION_MS, STALE_MS = RETENTION_DAYS * 24 * _HOUR, int(STALE_HOURS * _HOUR)
CHANGES = "cluster_id string, n_articles int, first_reported timestamp, last_updated timestamp, publishers string, status string, as_of timestamp"
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(value) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class StoryState(StatefulProcessor):
    """State of one story: a map from article id to its time and publisher, and what was told last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.articles = handle.getMapState("articles", "id string", "published long, publisher string")
        self.told = handle.getValueState("told", "n int, first long, last long, publishers string, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for row in frame.itertuples(index=False):
                published, publisher = _ms(row.published_ts), row.publisher_id or ""
                if published <= oldest:
                    continue
                kept = self.articles.getValue((row.id,)) if self.articles.containsKey((row.id,)) else None
                # An article that comes again counts once: the earlier of its forms, in whatever order they come.
                if kept is None or (published, publisher) < tuple(kept):
                    self.articles.updateValue((row.id,), (published, publisher))
        yield from self._settle(key[0], oldest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key[0], timerValues.getCurrentWatermarkInMs())

    def _settle(self, name: str, oldest: int) -> Iterator[pd.DataFrame]:
        """Drops expired articles, sets the next timer, and tells what has changed."""
        live, gone = [], []
        for (article,), (published, publisher) in list(self.articles.iterator()):
            gone.append(article) if published <= oldest else live.append((published, publisher))
        for article in gone:
            self.articles.removeKey((article,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        before = tuple(self.told.get()) if self.told.exists() else None
        if not live:
            self.told.clear()
            if before is not None:
                yield self._row(name, (0, before[1], before[2], "", "gone"), oldest)
            return
        first, last = min(live)[0], max(live)[0]
        stale_at = last + STALE_MS - RETENTION_MS  # on the watermark's clock
        now = (len(live), first, last, ",".join(sorted({p for _, p in live})), "stale" if stale_at <= oldest else "active")
        self.handle.registerTimer(first if stale_at <= oldest else min(first, stale_at))
        if now != before:
            self.told.update(now)
            yield self._row(name, now, oldest)

    @staticmethod
    def _row(name: str, now: tuple, oldest: int) -> pd.DataFrame:
        n, first, last, publishers, status = now
        return pd.DataFrame([(name, n, _time(first), _time(last), publishers, status, _time(oldest + RETENTION_MS))], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def story_changes(articles: DataFrame) -> DataFrame:
    """articles: a stream of id, cluster_id, publisher_id, published_ts (timestamp) -> the changes of stories, in update mode.

    status: active; stale after ``STALE_HOURS`` without an article; gone when no article is within the retention period.
    Articles without a story, an id or a time stay out.
    """
    articles.sparkSession.conf.set(*PROVIDER)
    rows = articles.filter("id is not null and cluster_id is not null and published_ts is not null").select("id", "cluster_id", "publisher_id", "published_ts")
    rows = rows.withWatermark("published_ts", f"{RETENTION_DAYS} days")
    return rows.groupBy("cluster_id").transformWithStateInPandas(StoryState(), CHANGES, "Update", "EventTime")


def stories_as_of(articles: DataFrame) -> DataFrame:
    """The same stories from a table of all articles, as of the newest: cluster_id, n_articles, first_reported, last_updated, publishers, status."""
    rows = articles.filter("id is not null and cluster_id is not null and published_ts is not null")
    newest = rows.agg(F.max("published_ts")).scalar()
    one = rows.groupBy("cluster_id", "id").agg(F.min(F.struct("published_ts", F.coalesce("publisher_id", F.lit("")).alias("publisher"))).alias("a"), F.first(newest).alias("newest"))
    live = one.filter(F.col("a.published_ts") > F.col("newest") - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"))
    facts = live.groupBy("cluster_id").agg(F.count("*").cast("int").alias("n_articles"), F.min("a.published_ts").alias("first_reported"), F.max("a.published_ts").alias("last_updated"), F.array_join(F.array_sort(F.collect_set("a.publisher")), ",").alias("publishers"), F.first("newest").alias("newest"))
    status = F.when(F.col("last_updated") <= F.col("newest") - F.expr(f"INTERVAL {int(STALE_HOURS)} HOURS"), "stale").otherwise("active")
    return facts.select("cluster_id", "n_articles", "first_reported", "last_updated", "publishers", status.alias("status"))


def latest(changes: DataFrame) -> DataFrame:
    """The stories that are left, from a table of changes (batch: the number of the batch that told them)."""
    last = changes.groupBy("cluster_id").agg(F.max_by(F.struct("n_articles", "first_reported", "last_updated", "publishers", "status"), F.col("batch")).alias("s"))
    return last.select("cluster_id", "s.*").filter("status <> 'gone'")
