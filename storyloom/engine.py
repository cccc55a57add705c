"""The commands of the application over tables in a folder: refresh, feed, publishers, bodies, summaries, split, merge, wipe.

Each table is a folder of numbered versions, and a manifest names the version of every table and the schema it was written with.  A command
writes the next versions of all tables that it changes, looks that their keys are keys, and then writes one new manifest, by a rename; readers follow
the last manifest, so a command that fails half-way leaves all tables as they were.  Versions and manifests before the last
``keep_versions`` go, and so do the tables that a command needed on its way.  One writer at a time.

A command on a few rows (split, merge, bodies, summaries) writes these rows only: a version has a base and changes after it, rows with the keys
that they replace or remove, and readers put the last row of each changed key in the base's place.  After ``compact_after`` changes the
next one writes a new base.

Tables of an earlier schema are read with the columns of today's: those that their files lack have their defaults, and the next
command that writes the table writes them.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .constants import DEFAULT_BIAS, RETENTION_DAYS, STOP_WORDS
from .functions.texts import cluster_text, effective_headline
from .functions.urls import absolute_url, classify, domain, favicon, slug_words
from .intermediate import delete, scope, written
from .operators import changes as C, greedy as G, greedy_parts as P, similarity as Y, stories as R
from .operators.translation import Translator, translated
from .sources.discover import bodies, discover
from .sources.feeds import keep_first
from .sources.tables import ARTICLES, CLUSTERS, CUSTOM_PUBLISHERS, publishers

SCHEMAS = {"articles": ARTICLES, "clusters": CLUSTERS, "custom_publishers": CUSTOM_PUBLISHERS}
#: Goes up with every change of a schema; changes only add columns.
SCHEMA_VERSION = 2
#: Columns that came after the first schema, with what rows from before have in them.
ADDED = {
    "articles": {"translated_headline": "", "body_text": "", "category": "general"},
    "clusters": {"ai_headline": "", "ai_summary": ""},
    "custom_publishers": {"scrape_method": "rss", "scrape_config": ""},
}
#: Articles that one task assigns to stories; more are assigned in parts.
DESK_ROWS = 20_000
#: Each table's keys: no two rows share a value of one of them, and none is null.
KEYS = {"articles": ["id", "original_url"], "clusters": ["id"], "custom_publishers": ["id", "rss_url"]}


def _with_gone(name: str) -> T.StructType:
    return T.StructType([*SCHEMAS[name].fields, T.StructField("__gone", T.BooleanType())])


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A list of words, one a line, from a text file."""
    return [r[0] for r in spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).filter("w <> ''").distinct().orderBy("w").collect()]  # a stop list


def _command(f: Callable) -> Callable:
    """A command's intermediate tables go when it has been committed, or has failed."""

    @functools.wraps(f)
    def run(self, *args, **kwargs):
        with scope(self.spark):
            return f(self, *args, **kwargs)

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, stop_words: Sequence[str] = STOP_WORDS, keep_versions: int = 3, compact_after: int = 8, desk_rows: int = DESK_ROWS):
        """stop_words: the whole list of the desk (see ``read_words``); the similarity of articles depends on it.

        desk_rows: with more articles than that in the retention period they are assigned to stories in parts, with the same result.

        ``stats`` has the numbers of the last refresh: articles_scraped, articles_new, clusters_created, failed_sources.
        """
        self.spark, self.root, self.stop_words, self.keep_versions = spark, root.rstrip("/"), list(stop_words), max(1, keep_versions)
        self.compact_after, self.desk_rows = max(0, compact_after), desk_rows
        self.stats: dict[str, int | list[str]] = {}

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._path("_manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _read_manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/_manifest/{number}.json", wholetext=True).first()[0])

    def _manifest(self) -> tuple[int, dict[str, int]]:
        """(number, base of each table) of the last manifest; (0, {}) before the first."""
        numbers = self._manifests()
        return (numbers[-1], {k: v for k, v in self._read_manifest(numbers[-1]).items() if not k.startswith("_")}) if numbers else (0, {})

    def schema_version(self) -> int:
        """The schema that the last command wrote with; 1 before manifests named it."""
        numbers = self._manifests()
        return self._read_manifest(numbers[-1]).get("_schema", 1) if numbers else SCHEMA_VERSION

    def _changes(self) -> dict[str, list[int]]:
        """The changes after each table's base, in order."""
        numbers = self._manifests()
        return dict(self._read_manifest(numbers[-1]).get("_changes", {})) if numbers else {}

    def table(self, name: str) -> DataFrame:
        version, schema = self._manifest()[1].get(name), SCHEMAS[name]
        changes = [self.spark.read.schema(_with_gone(name)).parquet(f"{self.root}/{name}/d{n}").withColumn("__n", F.lit(n)) for n in self._changes().get(name, [])]
        if version:
            path = f"{self.root}/{name}/v{version}"
            rows = self.spark.read.schema(schema).parquet(path)
            if self.schema_version() < SCHEMA_VERSION:
                there = set(self.spark.read.parquet(path).columns)
                rows = rows.withColumns({c: F.lit(v).alias(c) for c, v in ADDED[name].items() if c not in there})
            rows = rows.select(*schema.names)
        else:
            rows = self.spark.createDataFrame([], schema)
        if changes:
            every = functools.reduce(DataFrame.unionByName, changes)
            last = every.groupBy("id").agg(F.max_by(F.struct(*[c for c in every.columns if c not in ("id", "__n")]), "__n").alias("r")).select("id", "r.*")
            rows = rows.join(last.select("id"), "id", "left_anti").select(*schema.names).unionByName(last.filter("not __gone").select(*schema.names))
        return rows

    def _check_keys(self, name: str, path: str) -> None:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(path)
        for key in KEYS[name]:
            if not rows.groupBy(key).agg(F.count("*").alias("n")).filter(f"n > 1 or {key} is null").isEmpty():
                raise ValueError(f"{name}: values of {key} that are missing or not unique")

    def _write(self, name: str, df: DataFrame, number: int) -> None:
        path = f"{self.root}/{name}/v{number}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]).write.mode("overwrite").parquet(path)
        self._check_keys(name, path)

    def _commit(self, **tables: DataFrame) -> None:
        """Writes the next version of each table and makes all of them current at once."""
        self._publish(tables, {})

    def _change(self, **states: tuple[DataFrame, DataFrame]) -> None:
        """states: some rows of a table before and after; writes what differs as a change, or a new base when there are enough changes."""
        self._publish({}, states)

    def _publish(self, tables: dict[str, DataFrame], states: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        number, versions = self._manifest()
        changes = self._changes()
        # The tables that stay are written with today's schema, too.
        stay = versions.keys() - tables.keys() if self._manifests() and self.schema_version() < SCHEMA_VERSION else set()
        tables = tables | {name: self.table(name) for name in stay}
        for name, df in tables.items():
            self._write(name, df, number + 1)
        for name, (before, after) in states.items():
            gone = before.select("id").join(after.select("id"), "id", "left_anti").select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields if f.name != "id"])
            rows = after.select(*SCHEMAS[name].names).exceptAll(before.select(*SCHEMAS[name].names)).withColumn("__gone", F.lit(False)).unionByName(gone.withColumn("__gone", F.lit(True)))
            path = f"{self.root}/{name}/d{number + 1}"
            rows.write.mode("overwrite").parquet(path)  # few rows make few files: small partitions are joined at run time
            if not self.spark.read.parquet(path).groupBy("id").count().filter("count > 1 or id is null").isEmpty():
                raise ValueError(f"{name}: values of id that are missing or not unique")
        names = dict.fromkeys(tables, number + 1)
        after = {k: v for k, v in changes.items() if k not in tables} | {k: [*changes.get(k, []), number + 1] if k not in tables else [number + 1] for k in states}
        self._set_manifest(number + 1, versions | names | {"_schema": SCHEMA_VERSION, "_changes": after})
        if full := [name for name, made in after.items() if len(made) > self.compact_after]:
            self._commit(**{name: self.table(name) for name in full})
        self._expire()

    def _set_manifest(self, number: int, content: dict) -> None:
        draft, fs = self._path("_manifest", f"_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(draft, self._path("_manifest", f"{number}.json")[0]):
            raise RuntimeError("another command has written at the same time")

    def _expire(self) -> None:
        """Removes manifests before the last ones that are kept, and bases and changes that none of those names; readers of a kept version are not disturbed."""
        numbers = self._manifests()
        named: set[str] = set()
        for n in numbers[-self.keep_versions :]:
            content = self._read_manifest(n)
            named |= {f"{k}/v{v}" for k, v in content.items() if not k.startswith("_")} | {f"{k}/d{v}" for k, made in content.get("_changes", {}).items() for v in made}
        for name in SCHEMAS:
            path, fs = self._path(name)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                folder = status.getPath().getName()
                if folder[:1] in "vd" and folder[1:].isdigit() and int(folder[1:]) <= numbers[-1] and f"{name}/{folder}" not in named:
                    delete(self.spark, f"{self.root}/{name}/{folder}")
        for n in numbers[: -self.keep_versions]:
            delete(self.spark, f"{self.root}/_manifest/{n}.json")

    def get_publishers(self) -> DataFrame:
        """Fixed and custom sources."""
        own = self.table("custom_publishers").select("id", "name", F.lit(DEFAULT_BIAS).alias("bias_category"), favicon(F.col("rss_url")).alias("logo_url"), "is_global")
        return publishers(self.spark).select("id", "name", "bias_category", "logo_url", F.lit(False).alias("is_global")).unionByName(own)

    def _with_bias(self, articles: DataFrame, known_only: bool) -> DataFrame:
        dim = publishers(self.spark).select(F.col("id").alias("publisher_id"), F.col("bias_category").alias("bias"))
        out = articles.join(F.broadcast(dim), "publisher_id", "left")  # nine rows
        return out if known_only else out.withColumn("bias", F.coalesce("bias", F.lit(DEFAULT_BIAS)))

    def get_clusters(self, blindspots_only: bool = False) -> DataFrame:
        """Stories with their articles, newest first."""
        dto = self._with_bias(self.table("articles").filter("cluster_id is not null"), False)
        return R.feed(self.table("clusters"), dto, blindspots_only)

    def _text(self) -> Column:
        """What articles are compared by."""
        return cluster_text(effective_headline(F.col("language"), F.col("headline"), F.col("translated_headline")), F.col("snippet"), slug_words(F.col("original_url")))

    @_command
    def refresh(self, raw: DataFrame, as_of: str, translate: Column | None = None, failed: DataFrame | None = None) -> dict[str, int]:
        """raw: articles from the readers (storyloom.sources.feeds).  Prunes, adds new articles, assigns them to stories, merges stories, rolls up.

        failed: publisher_id of the sources that brought nothing, for ``stats``.  Counts are observed while the tables are written.
        """
        cutoff = self.spark.range(1).select(F.date_format(F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        scraped, added, created = Observation(), Observation(), Observation()
        stored, _ = C.prune(self.table("articles"), self.table("clusters"), cutoff)
        raw = written(raw.observe(scraped, F.count(F.lit(1)).alias("n")))
        rows = keep_first(raw, "original_url", "publisher_id", "pos") if "pos" in raw.columns else raw.dropDuplicates(["original_url"])
        rows = C.translated_or_marked(rows.withColumn("cluster_id", F.lit(None).cast("string")).select(*[f.name for f in ARTICLES.fields]), stored, translate)
        rows = rows.withColumn("category", classify(F.col("original_url"), effective_headline(F.col("language"), F.col("headline"), F.col("translated_headline"))))
        new = written(C.new_articles(stored, rows, "published_at").observe(added, F.count(F.lit(1)).alias("n")))
        everything, n_new = stored.unionByName(new.select(*stored.columns)), added.get["n"]
        self.stats = {"articles_scraped": scraped.get["n"], "articles_new": n_new, "clusters_created": 0, "failed_sources": [] if failed is None else sorted(r[0] for r in failed.collect())}  # a list of sites
        if n_new:
            # One desk's retention period: stored stories and new articles in one order, so new ones also meet by each other.
            began = stored.filter("cluster_id is not null").unionByName(new.withColumn("cluster_id", F.lit(None).cast("string")).select(*stored.columns))
            assigned = self._assigned(began)
            assigned = written(assigned.observe(created, F.count_if(F.col("id") == F.col("cluster_id")).alias("n")))
            everything = self._merged(C.set_value(everything, assigned, "cluster_id"))
            self.stats["clusters_created"] = created.get["n"]
        self._store(everything, self.table("clusters"))
        return {"scraped": self.stats["articles_scraped"], "new": n_new}

    def _assigned(self, began: DataFrame) -> DataFrame:
        """id, cluster_id of the articles without a story: in one group where it is small, else in parts that cannot meet."""
        began = written(began)
        assign = G.greedy_assign if began.count() <= self.desk_rows else P.assign_in_parts
        return assign(began, self._text(), stop_words=self.stop_words)

    def _merged(self, articles: DataFrame) -> DataFrame:
        """The second pass: articles of stories that are alike enough move to the larger one, chains to their end."""
        articles = written(articles)
        in_story = articles.filter("cluster_id is not null")
        edges = Y.resolve_merges(Y.merge_edges(in_story, self._text(), self.stop_words))
        return C.merge_clusters(articles, self.table("clusters"), edges)[0]

    def _store(self, articles: DataFrame, clusters: DataFrame) -> None:
        """The articles and the stories rolled up from them."""
        articles = written(articles)
        art = articles.filter("cluster_id is not null")
        head = effective_headline(F.col("language"), F.col("headline"), F.col("translated_headline"))
        rated = self._with_bias(art, True)
        new = R.best_headline(rated, head).join(R.blindspot(rated), "cluster_id").join(art.groupBy("cluster_id").agg(F.min("published_at").alias("first_reported"), F.max("published_at").alias("last_updated")), "cluster_id")
        new = new.select(F.col("cluster_id").alias("id"), "headline", "first_reported", "last_updated", "is_blindspot", F.lit("").alias("ai_headline"), F.lit("").alias("ai_summary"))
        self._commit(articles=articles, clusters=C.orphans_gone(art, C.upsert_clusters(clusters, new)))

    @_command
    def recluster(self) -> None:
        """All stories anew, in the order of time, and the second pass over them."""
        art = self.table("articles")
        fresh, none = C.wipe_clusters(art, self.table("clusters"))
        began = art.withColumn("cluster_id", F.lit(None).cast("string"))
        self._store(self._merged(C.set_value(fresh, self._assigned(began), "cluster_id")), none)

    @_command
    def split(self, article_id: str) -> str:
        """The article gets a story of its own, named after it; only the stories that it leaves and makes are read and written."""
        own = f"split-{article_id}"
        art, cl = self.table("articles"), self.table("clusters")
        before = written(art.filter(F.col("id") == article_id).select(F.col("cluster_id").alias("id")).unionByName(self.spark.createDataFrame([(own,)], "id string")).filter("id is not null"))
        mine = art.join(before.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select(*art.columns).unionByName(art.filter((F.col("id") == article_id) & F.col("cluster_id").isNull()))
        stories = cl.join(before, "id", "left_semi").select(*cl.columns)
        moved, left = C.split_article(mine, stories, article_id, own)
        self._change(articles=(mine, moved), clusters=(stories, left))
        return own

    @_command
    def merge(self, merges: DataFrame) -> None:
        """merges: from_id, to_id."""
        resolved = written(Y.resolve_merges(merges))
        gone = resolved.select(F.col("from_id").alias("cluster_id"))
        art, cl = self.table("articles"), self.table("clusters")
        mine = art.join(gone, "cluster_id", "left_semi").select(*art.columns)
        stories = cl.join(gone.withColumnRenamed("cluster_id", "id"), "id", "left_semi").select(*cl.columns)
        moved, left = C.merge_clusters(mine, stories, resolved)
        self._change(articles=(mine, moved), clusters=(stories, left))

    @_command
    def cache_bodies(self, fetched: DataFrame) -> None:
        """fetched: id, body_text, image_url."""
        art = self.table("articles")
        mine = art.join(fetched.select("id"), "id", "left_semi").select(*art.columns)
        self._change(articles=(mine, C.cache_body(mine, fetched)))

    def cluster_summary(self) -> DataFrame:
        """id, headline, summary: the stored summary, else the first headline and the first snippet that isn't empty."""
        art = self.table("articles").filter("cluster_id is not null").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("published_at", "id", "headline", "snippet"))).alias("a"))
        rows = self.table("clusters").join(art, F.col("id") == F.col("cluster_id"))
        snippet = F.coalesce(F.get(F.filter(F.transform("a", lambda x: x["snippet"]), lambda s: s != ""), F.lit(0)), F.lit(""))
        stored = F.col("ai_headline") != ""
        return rows.select("id", F.when(stored, F.col("ai_headline")).otherwise(F.element_at("a", 1)["headline"]).alias("headline"), F.when(stored, F.col("ai_summary")).otherwise(snippet).alias("summary"))

    @_command
    def cache_summaries(self, summaries: DataFrame) -> None:
        """summaries: id, ai_headline, ai_summary."""
        cl = self.table("clusters")
        mine = cl.join(summaries.select("id"), "id", "left_semi").select(*cl.columns)
        self._change(clusters=(mine, C.cache_summary(mine, summaries)))

    def discover_publishers(self, sites: DataFrame, fetched: DataFrame) -> DataFrame:
        """sites: site (the id), url, name, is_global; fetched: url, body -> rows of custom_publishers for the sites that can be read, added to the table."""
        found = discover(sites, fetched).filter("method is not null").join(sites.select("site", "url", "name", "is_global"), "site")
        host = domain(absolute_url(F.col("url")))
        name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.col("title"), F.lit("")), host)
        rows = found.select(F.col("site").alias("id"), name.alias("name"), F.col("scrape_url").alias("rss_url"), F.col("method").alias("scrape_method"), "scrape_config", "is_global")
        self.add_publisher(rows)
        return rows

    def article_bodies(self, wanted: DataFrame, fetched: DataFrame) -> DataFrame:
        """wanted: id; fetched: url, body -> id, body_text, image_url, stored ones first; fresh ones are kept."""
        found = bodies(self.table("articles").join(wanted.select("id"), "id", "left_semi"), fetched)
        self.cache_bodies(found)
        return found

    @_command
    def add_publisher(self, row: DataFrame) -> None:
        self._commit(custom_publishers=C.upsert_publisher(self.table("custom_publishers"), row))

    @_command
    def remove_publisher(self, publisher_id: str) -> None:
        own, art = C.delete_publisher(self.table("custom_publishers"), self.table("articles"), publisher_id)
        self._commit(custom_publishers=own, articles=art)

    def translate_summary(self, cluster_id: str, translator: Translator) -> DataFrame:
        """id, headline, summary of one story in the other language; what can't be translated stays as it is."""
        return translated(self.cluster_summary().filter(F.col("id") == cluster_id), ["headline", "summary"], translator)

    @_command
    def wipe(self) -> None:
        self._commit(**{name: self.table(name).limit(0) for name in ("articles", "clusters")})
