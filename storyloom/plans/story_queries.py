"""Queries over ``documents`` seen as articles: roll-ups, feed views, table changes and similarity.

Story keys, publishers and times are synthetic (README), so these check the operators' logic on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..constants import BIAS_CATEGORIES, HTML_ENTITIES, INDEPENDENT, PUBLISHERS, SOURCE_SCORE, STOP_WORDS
from ..functions import markup as M, texts as X
from ..functions.urls import domain
from ..intermediate import numbered, written
from ..operators import changes as C, greedy as G, greedy_parts as P, incremental as I, similarity as Y, stories as R
from ..sources.tables import DOCUMENT_ARTICLES_SQL as ART, document_articles, page_articles, publishers, table
from .registry import query

AS = f"WITH {ART}"
OVERRIDES = {"times_of_malta": "centre", "newsbook": "left", "independent": "state_owned"}
BIAS_SQL = "CASE publisher_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OVERRIDES.items()) + " ELSE bias END"
INDEP = "(" + ", ".join(f"'{b}'" for b in INDEPENDENT) + ")"
SCORE = "CASE bias " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_SCORE.items()) + " ELSE 1 END"
EFFECTIVE = "CASE WHEN language = 'en' THEN headline ELSE coalesce(nullif(translated_headline, ''), headline) END"
CLUSTERS = "cl AS (SELECT cluster_id AS id, min(published_at) AS first_reported, max(published_at) AS last_updated, substr(cluster_id, 2)::INT % 3 = 0 AS is_blindspot, min_by(headline, id) AS headline FROM art GROUP BY cluster_id)"
DOMINANT = "dc AS (SELECT cluster_id, CASE WHEN count(*) = 1 OR max(n) >= 2 THEN (array_agg(category ORDER BY n DESC, category))[1] ELSE 'general' END AS category FROM (SELECT cluster_id, category, count(*) AS n FROM art GROUP BY 1, 2) GROUP BY cluster_id)"


def _clusters(art):
    c = art.groupBy(F.col("cluster_id").alias("id")).agg(F.min("published_at").alias("first_reported"), F.max("published_at").alias("last_updated"), (F.substring(F.first("cluster_id"), 2, 20).cast("int") % 3 == 0).alias("is_blindspot"), F.min_by("headline", "id").alias("headline"))
    return c.select("id", "headline", "first_reported", "last_updated", "is_blindspot", F.lit("").alias("ai_headline"), F.lit("").alias("ai_summary"))


def _art(spark, d):
    return document_articles(spark, d)


@query("q_feed", f"{AS}, {CLUSTERS} SELECT cl.id AS cluster_id, cl.last_updated, art.id AS article_id, art.published_at, row_number() OVER (PARTITION BY cl.id ORDER BY art.published_at, art.id)::INT AS pos FROM cl JOIN art ON art.cluster_id = cl.id")
def q_feed(spark, d):
    art = _art(spark, d).select("id", "cluster_id", "published_at")
    rows = R.feed(_clusters(_art(spark, d)), art)
    return rows.select(F.col("id").alias("cluster_id"), "last_updated", F.posexplode("articles").alias("pos", "a")).select("cluster_id", "last_updated", F.col("a.id").alias("article_id"), "a.published_at", (F.col("pos") + 1).alias("pos"))


@query("q_feed_blindspots", f"{AS}, {CLUSTERS} SELECT cl.id, count(*)::INT AS n FROM cl JOIN art ON art.cluster_id = cl.id WHERE is_blindspot GROUP BY cl.id")
def q_feed_blindspots(spark, d):
    return R.feed(_clusters(_art(spark, d)), _art(spark, d).select("id", "cluster_id", "published_at"), True).select("id", F.size("articles").alias("n"))


@query("a_cluster_rollup", f"{AS} SELECT cluster_id, max(published_at) AS last_published, array_to_string(list_sort(list(DISTINCT publisher_id)), ',') AS publishers FROM art GROUP BY cluster_id")
def a_cluster_rollup(spark, d):
    return R.cluster_publishers(_art(spark, d)).withColumn("publishers", F.array_join("publishers", ","))


@query("q_all_cluster_headlines", f"{AS} SELECT cluster_id, count(*)::BIGINT AS n, string_agg(headline, '|' ORDER BY published_at, id) AS headlines FROM art GROUP BY cluster_id")
def q_all_cluster_headlines(spark, d):
    rows = _art(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("published_at", "id", "headline"))).alias("h"))
    return rows.select("cluster_id", "n", F.array_join(F.transform("h", lambda x: x["headline"]), "|").alias("headlines"))


@query("q_recluster_scan", f"{AS} SELECT id, publisher_id, headline, translated_headline, language, published_at, category FROM art")
def q_recluster_scan(spark, d):
    return _art(spark, d).select("id", "publisher_id", "headline", "translated_headline", "language", "published_at", "category").orderBy("published_at", "id")


@query("a_dominant_category", f"{AS}, {DOMINANT} SELECT cluster_id, category FROM dc")
def a_dominant_category(spark, d):
    return R.dominant_category(_art(spark, d))


@query("a_blindspot", f"{AS} SELECT cluster_id, NOT bool_or(bias IN {INDEP}) AS is_blindspot FROM art GROUP BY cluster_id")
def a_blindspot(spark, d):
    return R.blindspot(_art(spark, d))


@query("a_blindspot_override", f"{AS} SELECT cluster_id, NOT bool_or({BIAS_SQL} IN {INDEP}) AS is_blindspot FROM art GROUP BY cluster_id")
def a_blindspot_override(spark, d):
    return R.blindspot_with_overrides(_art(spark, d), OVERRIDES)


@query("a_best_headline", f"{AS} SELECT cluster_id, h AS headline FROM (SELECT cluster_id, {EFFECTIVE} AS h, row_number() OVER (PARTITION BY cluster_id ORDER BY {SCORE} DESC, strlen({EFFECTIVE}) DESC, published_at DESC, id DESC) AS n FROM art) WHERE n = 1")
def a_best_headline(spark, d):
    return R.best_headline(_art(spark, d), X.effective_headline(F.col("language"), F.col("headline"), F.col("translated_headline")))


_COVER = f"""{AS}, b AS (SELECT cluster_id, {BIAS_SQL} AS bias FROM art), t AS (SELECT cluster_id, count(*) AS total FROM b GROUP BY 1),
k AS (SELECT unnest([{', '.join(repr(c) for c in BIAS_CATEGORIES)}]) AS bias, unnest(range({len(BIAS_CATEGORIES)})) AS i),
e AS (SELECT t.cluster_id, total, k.i, k.bias, count(b.bias)::DOUBLE / total * 100 AS x FROM t CROSS JOIN k LEFT JOIN b ON b.cluster_id = t.cluster_id AND b.bias = k.bias GROUP BY t.cluster_id, total, k.i, k.bias),
r AS (SELECT *, floor(x) AS f, row_number() OVER (PARTITION BY cluster_id ORDER BY x - floor(x) DESC, i) AS n, 100 - sum(floor(x)) OVER (PARTITION BY cluster_id) AS left_ FROM e),
c AS (SELECT cluster_id, total, i, bias, (f + CASE WHEN n <= left_ THEN 1 ELSE 0 END)::INT AS p FROM r)"""


@query("a_bias_coverage", _COVER + " SELECT cluster_id, " + ", ".join(f"max(p) FILTER (bias = '{c}') AS {c}" for c in BIAS_CATEGORIES) + ", max(total)::BIGINT AS total_articles FROM c GROUP BY cluster_id")
def a_bias_coverage(spark, d):
    return R.bias_coverage(_art(spark, d), R.with_overrides(F.col("bias"), F.col("publisher_id"), OVERRIDES))


@query("s_segments", _COVER + " SELECT cluster_id, bias AS category, p AS percentage FROM c WHERE p > 0")
def s_segments(spark, d):
    return R.segments(a_bias_coverage(spark, d))


@query("a_articles_per_publisher", f"{AS} SELECT publisher_id, count(*)::BIGINT AS n FROM art GROUP BY publisher_id")
def a_articles_per_publisher(spark, d):
    return _art(spark, d).groupBy("publisher_id").agg(F.count("*").alias("n"))


@query("a_group_by_publisher", f"""{AS}, g AS (SELECT cluster_id, publisher_id, min(published_at || id) AS at, count(*) AS n FROM art GROUP BY 1, 2), f AS (SELECT g.*, (SELECT 1) AS o, row_number() OVER (PARTITION BY g.cluster_id ORDER BY m.p, m.i) AS r FROM g
  JOIN (SELECT cluster_id, publisher_id, min(published_at) AS p, (array_agg(id ORDER BY published_at, id))[1] AS i FROM art GROUP BY 1, 2) m USING (cluster_id, publisher_id))
SELECT cluster_id, string_agg(publisher_id, ',' ORDER BY r) FILTER (r <= 4) AS visible, greatest(0, count(*) - 4)::INT AS overflow FROM f GROUP BY cluster_id""")
def a_group_by_publisher(spark, d):
    return R.by_publisher(_art(spark, d))


@query("a_majority_lang", f"{AS} SELECT cluster_id, CASE WHEN count(*) FILTER (language = 'mt') * 2 > count(*) THEN 'mt' ELSE 'en' END AS language FROM art GROUP BY cluster_id")
def a_majority_lang(spark, d):
    return R.majority_language(_art(spark, d))


@query("a_first_image", f"{AS} SELECT cluster_id, (array_agg(image_url ORDER BY published_at, id) FILTER (image_url <> ''))[1] AS image FROM art GROUP BY cluster_id")
def a_first_image(spark, d):
    return R.first_with(_art(spark, d), "image_url", F.col("image_url") != "", "image")


@query("a_first_article", f"{AS} SELECT cluster_id, (array_agg(id ORDER BY published_at, id) FILTER (bias = 'party_owned_pl'))[1] AS pl FROM art GROUP BY cluster_id")
def a_first_article(spark, d):
    return R.first_with(_art(spark, d), "id", F.col("bias") == "party_owned_pl", "pl")


@query("s_timeline", f"{AS} SELECT cluster_id, id, published_at, n::INT AS position, n = 1 AS broke_story FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS n FROM art)")
def s_timeline(spark, d):
    return R.timeline(_art(spark, d))


@query("s_shuffle", f"""{AS}, c AS (SELECT cluster_id AS id, count(*) AS n FROM art GROUP BY 1),
h AS (SELECT id, n, list_reduce(list_transform(string_split(id, ''), lambda x: ord(x)::HUGEINT), lambda a, x: (a * 31 + x) % 4294967296, 7::HUGEINT) AS h FROM c)
SELECT id, n::BIGINT AS n_articles, ln(1 + n) + (h % 1000)::DOUBLE / 1000 * 2 AS score FROM h""")
def s_shuffle(spark, d):
    return R.shuffled(_art(spark, d).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n_articles")), 7)


@query("s_feed_order", f"{AS}, {CLUSTERS} SELECT id, row_number() OVER (ORDER BY last_updated DESC, id)::INT AS n FROM cl")
def s_feed_order(spark, d):
    return numbered(_clusters(_art(spark, d)).select("id", "last_updated"), "n", F.desc("last_updated"), F.asc("id")).select("id", "n")


@query("s_size_rank", f"{AS} SELECT cluster_id, count(*)::BIGINT AS n FROM art GROUP BY cluster_id")
def s_size_rank(spark, d):
    return _art(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id")


@query("f_feed_locality", f"{AS} SELECT id, cluster_id, publisher_id FROM art WHERE publisher_id NOT IN ('one_news', 'net_news') AND language = 'en'")
def f_feed_locality(spark, d):
    return R.local_feed(_art(spark, d), F.col("language") != "en", False, ["one_news", "net_news"]).select("id", "cluster_id", "publisher_id")


@query("f_feed_category", f"{AS} SELECT id, cluster_id FROM art WHERE cluster_id IN (SELECT cluster_id FROM art WHERE category = 'sport')")
def f_feed_category(spark, d):
    return R.stories_with_category(_art(spark, d), "sport").select("id", "cluster_id")


@query("f_dismissed", f"{AS} SELECT id FROM art WHERE cluster_id NOT IN (SELECT cluster_id FROM art WHERE doc_id % 24 = 5)")
def f_dismissed(spark, d):
    art = _art(spark, d)
    return art.join(art.filter("doc_id % 24 = 5").select("cluster_id").distinct(), "cluster_id", "left_anti").select("id")


@query("f_is_new", f"{AS}, {CLUSTERS} SELECT id, first_reported > '2024-01-15T00:00:00+00:00' AS is_new FROM cl")
def f_is_new(spark, d):
    return _clusters(_art(spark, d)).select("id", (F.col("first_reported") > "2024-01-15T00:00:00+00:00").alias("is_new"))


@query("f_recency", f"{AS} SELECT id FROM art WHERE published_at >= '2024-01-20T00:00:00'")
def f_recency(spark, d):
    return _art(spark, d).filter(F.to_timestamp("published_at") >= F.lit("2024-01-22 00:00:00").cast("timestamp") - F.expr("INTERVAL 48 HOURS")).select("id")


@query("p_effective_headline", f"{AS} SELECT id, {EFFECTIVE} AS headline FROM art")
def p_effective_headline(spark, d):
    return _art(spark, d).select("id", X.effective_headline(F.col("language"), F.col("headline"), F.col("translated_headline")).alias("headline"))


@query("x_article_headline", f"{AS} SELECT id, CASE WHEN language = 'mt' THEN headline ELSE coalesce(nullif(translated_headline, ''), headline) END AS headline FROM art")
def x_article_headline(spark, d):
    return _art(spark, d).select("id", X.article_headline(F.lit("mt"), F.col("language"), F.col("headline"), F.col("translated_headline")).alias("headline"))


@query("p_article_dto", f"{AS} SELECT id, coalesce(nullif(translated_headline, ''), headline) AS translated, publisher_id, bias AS bias_category FROM art")
def p_article_dto(spark, d):
    art, dim = _art(spark, d), publishers(spark).select(F.col("id").alias("publisher_id"), "bias_category")
    return art.join(F.broadcast(dim), "publisher_id", "left").select("id", X.nonempty(F.col("translated_headline"), F.col("headline")).alias("translated"), "publisher_id", F.coalesce("bias_category", F.lit("commercial_independent")).alias("bias_category"))


@query("src_publishers", f"{AS}, p AS (SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', '{p[2]}', '{p[3]}', '{p[5]}')" for p in PUBLISHERS) + ") t(id, name, bias_category, language, method)) SELECT p.*, count(art.id)::BIGINT AS n_articles FROM p LEFT JOIN art ON publisher_id = p.id GROUP BY ALL")
def src_publishers(spark, d):
    """The fixed sources, with the number of articles that each has."""
    n = _art(spark, d).groupBy(F.col("publisher_id").alias("id")).agg(F.count("*").alias("n_articles"))
    return publishers(spark).drop("logo_url").join(n, "id", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))


@query("x_source_score", f"{AS} SELECT id, ({SCORE})::INT AS score FROM art")
def x_source_score(spark, d):
    return _art(spark, d).select("id", X.source_score(F.col("bias")).alias("score"))


@query("x_cluster_text", f"{AS} SELECT id, headline || CASE WHEN trim(snippet) <> '' THEN ' . ' || trim(snippet) ELSE '' END AS text FROM art")
def x_cluster_text(spark, d):
    return _art(spark, d).select("id", X.cluster_text(F.col("headline"), F.col("snippet"), F.lit("")).alias("text"))


@query("x_mt_entities", f"""{AS} SELECT id, array_to_string(list_filter(regexp_split_to_array(headline, '\\s+'), lambda w: strlen(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) >= 3
  AND (regexp_matches(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+', ''), '^\\p{{Lu}}') OR regexp_matches(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '^[0-9.]+$'))), ' ') AS words FROM art""")
def x_mt_entities(spark, d):
    return _art(spark, d).select("id", X.entity_words(F.col("headline")).alias("words"))


NORM = "regexp_replace(regexp_replace(regexp_replace({0}, '([0-9]),+', '\\1', 'g'), '([0-9])[kK]([^\\p{{L}}\\p{{N}}]|$)', '\\1000\\2', 'g'), '([0-9])[mM]([^\\p{{L}}\\p{{N}}]|$)', '\\1000000\\2', 'g')"


@query("x_norm_numbers", "SELECT doc_id, " + NORM.format("text") + " AS text FROM documents")
def x_norm_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_numbers(F.col("text")).alias("text"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _names():
    from ..constants import ENTITIES

    return "[" + ", ".join(f"'{w}'" for w in ENTITIES) + "]"


#: tok (id, cluster_id, pos, word, weight): the tokens of every headline, pairs last.
TOK = f"""
sp AS (SELECT id, cluster_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT id, cluster_id, regexp_split_to_array({NORM.format('snippet')}, '[^\\p{{L}}\\p{{N}}]') AS ws FROM art)),
sg AS (SELECT id, cluster_id, i, lower(w) AS word, CASE WHEN regexp_matches(lower(w), '^[0-9]+$') THEN 3 WHEN strlen(w) >= 2 AND regexp_matches(w, '^[\\p{{Lu}}\\P{{L}}]+$') THEN 2
  WHEN list_contains({_names()}, lower(w)) THEN 2 WHEN i > 0 AND regexp_matches(w, '^\\p{{Lu}}') THEN 2 ELSE 1 END AS weight
  FROM sp WHERE (strlen(lower(w)) > 2 OR (strlen(lower(w)) = 2 AND regexp_matches(w, '^\\p{{Lu}}+$'))) AND NOT list_contains({_STOPS}, lower(w))),
sn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n FROM sg),
nx AS (SELECT *, lead(word) OVER (PARTITION BY id ORDER BY i) AS next, lead(weight) OVER (PARTITION BY id ORDER BY i) AS next_weight FROM sn),
bi AS (SELECT id, cluster_id, word || '_' || next AS word, 3 AS weight, n + row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM nx WHERE weight >= 2 AND next_weight >= 2),
tok AS (SELECT id, cluster_id, pos, word, weight FROM sn UNION ALL SELECT id, cluster_id, pos, word, weight FROM bi)"""
IDF = "sc AS (SELECT count(DISTINCT cluster_id) AS n FROM tok), idf AS (SELECT word, count(DISTINCT cluster_id) AS df, ln((any_value(sc.n) + 1) / (count(DISTINCT cluster_id) + 1)) + 1 AS idf FROM tok, sc GROUP BY word)"


#: What the token queries read: the whole text of a document.
TEXT = "snippet"


def _rows(spark, d):
    return Y.token_rows(_art(spark, d), F.col(TEXT), "id", "cluster_id")


@query("x_tokenize", f"{AS}, {TOK} SELECT id, pos::INT AS pos, word, weight::INT AS weight FROM tok")
def x_tokenize(spark, d):
    return _rows(spark, d).select("id", "pos", "word", "weight")


@query("x_bigrams", f"{AS}, {TOK} SELECT id, word FROM bi")
def x_bigrams(spark, d):
    return _rows(spark, d).filter(F.col("word").contains("_")).select("id", "word")


@query("a_df_idf", f"{AS}, {TOK}, {IDF} SELECT word, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def a_df_idf(spark, d):
    return Y.idf_table(_rows(spark, d)).select("word", "df", F.round("idf", 6).alias("idf"))


@query("a_df_idf_incremental", f"{AS}, {TOK}, {IDF} SELECT word, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def a_df_idf_incremental(spark, d):
    """The same frequencies from two batches: stories as they were with every seventh article in its neighbour's story and every fifth not yet there, then the changes."""
    art = _art(spark, d).select("doc_id", "id", "cluster_id", F.col(TEXT).alias("text"))
    moved, late = F.col("doc_id") % 7 == 0, F.col("doc_id") % 5 == 0
    first = art.filter(~late).withColumn("cluster_id", F.when(moved, F.expr("concat('c', doc_id div 8 + 1)")).otherwise(F.col("cluster_id")))
    counts = I.counted(first, F.col("text"))
    changes = I.signed(first.filter(moved), art.filter(moved | late))
    return counts.add(changes).kept().idf_table().select("word", "df", F.round("idf", 6).alias("idf"))


@query("a_token_max", f"{AS}, {TOK} SELECT cluster_id, word, max(weight)::INT AS weight FROM tok GROUP BY 1, 2")
def a_token_max(spark, d):
    return Y.token_max(_rows(spark, d))


@query("a_token_union", f"{AS}, {TOK} SELECT cluster_id, count(DISTINCT word)::BIGINT AS n FROM tok GROUP BY 1")
def a_token_union(spark, d):
    return _rows(spark, d).groupBy("cluster_id").agg(F.countDistinct("word").alias("n"))


HOURS = lambda a, b: f"abs((substr({a},1,4)::DOUBLE * 8766 + substr({a},6,2)::DOUBLE * 730.5 + substr({a},9,2)::DOUBLE * 24 + substr({a},12,2)::DOUBLE) - (substr({b},1,4)::DOUBLE * 8766 + substr({b},6,2)::DOUBLE * 730.5 + substr({b},9,2)::DOUBLE * 24 + substr({b},12,2)::DOUBLE))"


@query("x_hours_between", f"{AS}, {CLUSTERS} SELECT art.id, {HOURS('published_at', 'last_updated')} AS hours, round(1 + 0.2 * exp(-{HOURS('published_at', 'last_updated')} / 12), 9) AS boost FROM art JOIN cl ON cl.id = cluster_id")
def x_hours_between(spark, d):
    art = _art(spark, d)
    rows = art.join(_clusters(art).select(F.col("id").alias("cluster_id"), "last_updated"), "cluster_id")
    h = X.hours_between(F.col("published_at"), F.col("last_updated"))
    return rows.select("id", h.alias("hours"), F.round(X.time_boost(h), 9).alias("boost"))


@query("x_threshold", f"{AS}, s AS (SELECT cluster_id, count(*) AS n, max(published_at) AS u FROM art GROUP BY 1) SELECT id, round((CASE WHEN {HOURS('published_at', 'u')} > 72 THEN 0.525 WHEN doc_id % 2 = 0 THEN 0.26 ELSE 0.35 END + CASE WHEN n >= 5 THEN 0.05 WHEN n <= 2 THEN -0.03 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.07 ELSE 0 END)::DOUBLE, 6) AS threshold FROM art JOIN s USING (cluster_id)")
def x_threshold(spark, d):
    art = _art(spark, d)
    rows = art.join(art.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("published_at").alias("u")), "cluster_id")
    t = X.threshold(X.hours_between(F.col("published_at"), F.col("u")), F.col("doc_id") % 2 == 0, F.col("n"), F.col("doc_id") % 3 == 0)
    return rows.select("id", F.round(t, 6).alias("threshold"))


_SIM = f"""{AS}, {TOK}, {IDF}, {DOMINANT},
a AS (SELECT id AS new_id, word, max_by(weight, pos) AS wa FROM tok GROUP BY 1, 2), av AS (SELECT new_id, word, wa, idf, wa * coalesce(idf, 1) AS va FROM a LEFT JOIN idf USING (word)),
na AS (SELECT new_id, sqrt(sum(va * va)) AS la FROM av GROUP BY 1),
b AS (SELECT id AS old_id, cluster_id, word, sum(weight * idf) AS vb, sum(weight * idf * weight * idf) AS v2 FROM tok JOIN idf USING (word) GROUP BY 1, 2, 3), nb AS (SELECT old_id, sqrt(sum(v2)) AS lb FROM b GROUP BY 1),
ct AS (SELECT DISTINCT cluster_id, word FROM tok), sh AS (SELECT new_id, cluster_id FROM a JOIN ct USING (word) GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT new_id, old_id, cluster_id, sum(va * vb) AS dot, bool_or(wa >= 2 AND strlen(word) >= 3 AND idf >= 3) AS anchor FROM av JOIN b USING (word) GROUP BY 1, 2, 3),
s AS (SELECT cluster_id, count(*) AS n, max(published_at) AS u, list(DISTINCT publisher_id) AS pubs FROM art GROUP BY 1),
q AS (SELECT p.new_id, p.cluster_id, dot / (la * lb) AS cosine, anchor, n, {HOURS('art.published_at', 'u')} AS h, list_contains(pubs, art.publisher_id) AS same FROM p JOIN na USING (new_id) JOIN nb USING (old_id) JOIN sh USING (new_id, cluster_id) JOIN s USING (cluster_id)
  JOIN dc USING (cluster_id) JOIN art ON art.id = p.new_id WHERE dc.category = art.category OR dc.category = 'general' OR art.category = 'general'),
t AS (SELECT *, cosine * (1 + 0.2 * exp(-h / 12)) AS score, CASE WHEN h > 72 THEN 0.525 WHEN anchor THEN 0.26 ELSE 0.35 END + CASE WHEN n >= 5 THEN 0.05 WHEN n <= 2 THEN -0.03 ELSE 0 END + CASE WHEN same THEN 0.07 ELSE 0 END AS least FROM q)"""


@query("j_article_cluster_sim", _SIM + " SELECT new_id AS id, cluster_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(score, 9) DESC, cluster_id) AS r FROM t WHERE score >= least) WHERE r = 1")
def j_article_cluster_sim(spark, d):
    art = _art(spark, d)
    return Y.best_story(art, art, F.col(TEXT)).select("id", "cluster_id", F.round("score", 6).alias("score"))


_MERGE = f"""{AS}, {TOK}, {IDF}, {DOMINANT}, bag AS (SELECT cluster_id, word, max(weight) AS w FROM tok GROUP BY 1, 2), v AS (SELECT cluster_id, word, w, idf, w * idf AS x FROM bag JOIN idf USING (word)), l AS (SELECT cluster_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1),
s AS (SELECT cluster_id, count(*) AS n FROM art GROUP BY 1),
p AS (SELECT a.cluster_id AS f, b.cluster_id AS t, sum(a.x * b.x) AS dot, count(*) AS k, bool_or(a.w >= 2 AND strlen(a.word) >= 3 AND a.idf >= 3) AS anchor FROM v a JOIN v b ON a.word = b.word AND a.cluster_id <> b.cluster_id GROUP BY 1, 2),
e AS (SELECT f AS from_id, t AS to_id, dot / (lf.l * lt.l) AS score FROM p JOIN l lf ON lf.cluster_id = f JOIN l lt ON lt.cluster_id = t JOIN s sf ON sf.cluster_id = f JOIN s st ON st.cluster_id = t JOIN dc df ON df.cluster_id = f JOIN dc dt ON dt.cluster_id = t
  WHERE k >= 3 AND anchor AND dot / (lf.l * lt.l) > 0.55 AND (df.category = dt.category OR df.category = 'general' OR dt.category = 'general') AND (st.n > sf.n OR st.n = sf.n AND t < f)),
m AS (SELECT from_id, to_id, score FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(score, 9) DESC, to_id) AS r FROM e) WHERE r = 1)"""


@query("j_cluster_cluster_sim", _MERGE + " SELECT from_id, to_id, round(score, 6) AS score FROM m")
def j_cluster_cluster_sim(spark, d):
    return Y.merge_edges(_art(spark, d), F.col(TEXT)).select("from_id", "to_id", F.round("score", 6).alias("score"))


@query("greedy_assign")
def greedy_assign(spark, d):
    """Documents as new articles of a desk for each language and source, in the order of time; a test holds it against a plain version of the rule."""
    art = _art(spark, d).withColumn("cluster_id", F.lit(None).cast("string"))
    return G.greedy_assign(art, F.col(TEXT), F.concat_ws("/", "language", "publisher_id"))


@query("greedy_assign_whole")
def greedy_assign_whole(spark, d):
    """The titles of all pages as new articles of one desk, of all publishers, in parts that cannot meet; a test holds it against the rule in one group."""
    n = F.col("page_id")
    time = F.concat(F.lit("2024-01-"), F.lpad((1 + n % 28).cast("string"), 2, "0"), F.lit("T"), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    titles = page_articles(spark, d).select(F.concat(F.lit("p"), n).alias("id"), domain(F.col("original_url")).alias("publisher_id"), time.alias("published_at"), "category", "headline")
    return P.assign_in_parts(titles, F.col("headline"))


@query("x_resolve_chain", f"""{AS}, m AS (SELECT DISTINCT doc_id // 8 AS k FROM art), ends AS (SELECT k, k % 7 AS r, k // 7 AS q FROM m)
SELECT 'c' || k AS from_id, 'c' || (SELECT min(k) FROM ends e WHERE e.q = ends.q) AS to_id FROM ends WHERE k > (SELECT min(k) FROM ends e WHERE e.q = ends.q)""")
def x_resolve_chain(spark, d):
    """Chains within every seven neighbouring stories: each points to the one before it."""
    n = F.floor(F.col("doc_id") / 8)
    own = _art(spark, d).select(n.alias("k")).distinct()
    before = F.lag("k").over(Window.partitionBy(F.floor(F.col("k") / 7)).orderBy("k"))
    edges = own.withColumn("p", before).filter("p is not null").select(F.concat(F.lit("c"), "k").alias("from_id"), F.concat(F.lit("c"), "p").alias("to_id"))
    return Y.resolve_merges(edges)


_STEPS = """acc AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS urls
  UNION ALL
  SELECT acc.n + 1, CASE WHEN list_contains(ids, id) OR list_contains(urls, url) THEN ids ELSE list_append(ids, id) END, CASE WHEN list_contains(ids, id) OR list_contains(urls, url) THEN urls ELSE list_append(urls, url) END
  FROM acc JOIN nw ON nw.n = acc.n + 1)"""


@query("dml_insert_article", f"""WITH RECURSIVE {AS.removeprefix('WITH ')}, old AS (SELECT id, original_url, headline FROM art WHERE bias = 'church_owned'),
free AS (SELECT 'a' || (doc_id * 5 // 8) AS id, 'https://ex.com/' || ((doc_id + 3) * 4 // 7) AS url, published_at, id AS headline FROM art),
nw AS (SELECT *, row_number() OVER (ORDER BY published_at, headline) AS n FROM free WHERE id NOT IN (SELECT id FROM old) AND url NOT IN (SELECT original_url FROM old)),
{_STEPS}, done AS (SELECT ids, urls FROM acc ORDER BY n DESC LIMIT 1), pairs AS (SELECT unnest(ids) AS id, unnest(urls) AS url FROM done)
SELECT id, original_url, headline FROM old UNION ALL SELECT id, url, min_by(headline, n) FROM nw JOIN pairs USING (id, url) GROUP BY 1, 2""")
def dml_insert_article(spark, d):
    """Rows that share ids with some neighbours and addresses with others, so that what is refused makes room for rows after it."""
    art = _art(spark, d).select("doc_id", "id", "original_url", "publisher_id", "published_at", "headline", "bias")
    old = art.filter("bias = 'church_owned'").select("id", "original_url", "publisher_id", "published_at", "headline")
    new = art.select(F.expr("concat('a', doc_id * 5 div 8)").alias("id"), F.expr("concat('https://ex.com/', (doc_id + 3) * 4 div 7)").alias("original_url"), "publisher_id", "published_at", F.col("id").alias("headline"))
    return C.insert_articles(old, new, "published_at", "headline").select("id", "original_url", "headline")


@query("dml_set_translated", f"{AS} SELECT id, CASE WHEN language = 'mt' THEN 'n ' || headline ELSE translated_headline END AS translated_headline FROM art")
def dml_set_translated(spark, d):
    art = _art(spark, d)
    return C.set_value(art, art.filter("language = 'mt'").select("id", F.concat(F.lit("n "), "headline").alias("translated_headline")), "translated_headline").select("id", "translated_headline")


@query("dml_upsert_cluster", f"{AS}, {CLUSTERS}, o AS (SELECT * FROM cl WHERE NOT is_blindspot), n AS (SELECT id, 'new' AS headline, '2024-01-16T00:00:00+00:00' AS first_reported, '2024-01-16T00:00:00+00:00' AS last_updated, true AS is_blindspot FROM cl) SELECT id, 'new' AS headline, coalesce(o.first_reported, n.first_reported) AS first_reported, greatest(o.last_updated, n.last_updated) AS last_updated, true AS is_blindspot FROM n LEFT JOIN o USING (id)")
def dml_upsert_cluster(spark, d):
    c = _clusters(_art(spark, d))
    at = F.lit("2024-01-16T00:00:00+00:00")
    new = c.select("id", F.lit("new").alias("headline"), at.alias("first_reported"), at.alias("last_updated"), F.lit(True).alias("is_blindspot"), "ai_headline", "ai_summary")
    return C.upsert_clusters(c.filter("not is_blindspot"), new).select("id", "headline", "first_reported", "last_updated", "is_blindspot")


@query("dml_prune", f"{AS}, k AS (SELECT * FROM art WHERE published_at >= '2024-01-20 00:00:00') SELECT DISTINCT cluster_id AS id FROM k")
def dml_prune(spark, d):
    art = _art(spark, d)
    return C.prune(art, _clusters(art), "2024-01-20 00:00:00")[1].select("id")


@query("dml_split", f"""{AS}, {CLUSTERS}, a2 AS (SELECT id, CASE WHEN id = 'a17' THEN 'own' ELSE cluster_id END AS cluster_id FROM art)
SELECT 'article' AS kind, id, cluster_id FROM a2 UNION ALL SELECT 'cluster', id, NULL FROM (SELECT id FROM cl UNION SELECT 'own') WHERE id IN (SELECT cluster_id FROM a2)""")
def dml_split(spark, d):
    art = _art(spark, d)
    return _both(*C.split_article(art, _clusters(art), "a17", "own"))


def _both(articles, clusters):
    """The articles' stories and the stories that are left, in one table."""
    rows = articles.select(F.lit("article").alias("kind"), "id", "cluster_id")
    return rows.unionByName(clusters.select(F.lit("cluster").alias("kind"), "id", F.lit(None).cast("string").alias("cluster_id")))


@query("dml_merge", f"""{AS}, {CLUSTERS} SELECT 'article' AS kind, id, CASE WHEN cluster_id IN ('c3', 'c4') THEN 'c1' ELSE cluster_id END AS cluster_id FROM art
UNION ALL SELECT 'cluster', id, NULL FROM cl WHERE id NOT IN ('c3', 'c4')""")
def dml_merge(spark, d):
    art = _art(spark, d)
    return _both(*C.merge_clusters(art, _clusters(art), spark.createDataFrame([("c3", "c1"), ("c4", "c1")], "from_id string, to_id string")))


@query("dml_wipe_clusters", f"{AS} SELECT id, NULL::VARCHAR AS cluster_id FROM art")
def dml_wipe_clusters(spark, d):
    art = _art(spark, d)
    return C.wipe_clusters(art, art)[0].select("id", "cluster_id")


@query("dml_custom_pub_delete", f"{AS} SELECT id FROM art WHERE publisher_id <> 'newsbook'")
def dml_custom_pub_delete(spark, d):
    art = _art(spark, d)
    return C.delete_publisher(publishers(spark), art, "newsbook")[1].select("id")


@query("dml_body_cache", f"{AS} SELECT id, body_text, CASE WHEN image_url = '' THEN 'new' ELSE image_url END AS image_url FROM art")
def dml_body_cache(spark, d):
    art = _art(spark, d)
    return C.cache_body(art, art.select("id", F.lit("later").alias("body_text"), F.lit("new").alias("image_url"))).select("id", "body_text", "image_url")


@query("f_skip_translation", f"{AS} SELECT id, CASE WHEN bias = 'church_owned' THEN headline WHEN language = 'mt' AND translated_headline = '' THEN headline ELSE translated_headline END AS translated_headline FROM art")
def f_skip_translation(spark, d):
    art = _art(spark, d)
    return C.translated_or_marked(art, art.filter("bias = 'church_owned'")).select("id", "translated_headline")


@query("x_read_minutes", "SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 200 + 0.5))::INT AS minutes FROM documents")
def x_read_minutes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.read_minutes(F.col("text")).alias("minutes"))


@query("x_card_snippet", f"{AS} SELECT id, left(coalesce(nullif(snippet, ''), split_part(body_text, chr(10) || chr(10), 1)), 140) AS snippet FROM art")
def x_card_snippet(spark, d):
    return _art(spark, d).select("id", X.card_snippet(F.lit(""), F.col("snippet"), F.col("body_text")).alias("snippet"))


@query("x_clean_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def x_clean_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_space(F.col("text")).alias("text"))


_ENTITIES = list(HTML_ENTITIES.items())


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_MARKED = f"replace(replace(text, '. ', {{e}}), ',', {{e}} || '&unknown;') || '&' || {{e}} || ' &amp'"


@query("x_decode_entities", f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_quoted(e)}, {_quoted(v)})" for k, (e, v) in enumerate(_ENTITIES))}) t(k, e, v)),
m AS (SELECT map(list(e ORDER BY k), list(v ORDER BY k)) AS m FROM e), d AS (SELECT doc_id, {_MARKED.format(e="e.e")} AS t FROM documents JOIN e ON k = doc_id % {len(_ENTITIES)})
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '&[^;]+;|[^&]+|&'), lambda p: coalesce(m[p], p)), '') AS text FROM d, m""")
def x_decode_entities(spark, d):
    """Whole documents whose full stops and commas became one of the entities, with unknown ones, one inside another and one that isn't ended."""
    entity = F.element_at(F.array(*[F.lit(e) for e, _ in _ENTITIES]), F.pmod("doc_id", F.lit(len(_ENTITIES))).cast("int") + 1)
    marked = table(spark, d, "documents").withColumn("e", entity).select("doc_id", F.expr(_MARKED.format(e="e")).alias("t"))
    return marked.select("doc_id", M.decode_entities(F.col("t")).alias("text"))


_PARTS = ["'The council of town ' || k || ' approved its budget plans.'", "'Residents of quarter ' || k || ' protested loudly yesterday.'", "'Engineers repaired bridge number ' || k || ' during winter.'"]


@query("x_combine_summary", f"""{AS}, k AS (SELECT DISTINCT cluster_id, substr(cluster_id, 2) AS k FROM art) SELECT cluster_id, {" || ' ' || ".join(_PARTS)} AS summary FROM k""")
def x_combine_summary(spark, d):
    """Each story from two bodies that say one thing alike, have a sentence of their own, and go on in a third paragraph."""
    k = F.substring("cluster_id", 2, 20)
    say = lambda p: F.concat(*[k if x == "k" else F.lit(x.strip("'")) for x in p.split(" || ")])
    one, two, three = map(say, _PARTS)
    more = F.lit("\n\nToo short. \n\nThe third paragraph of a body does not count at all.")
    bodies = F.array(F.concat(one, F.lit(" "), two, more), F.lit(""), F.concat(one, F.lit(" "), three, more))
    return _art(spark, d).select("cluster_id").distinct().select("cluster_id", X.combined_summary(bodies).alias("summary"))


@query("x_story_summaries")
def x_story_summaries(spark, d):
    """The combined summary of each story's documents."""
    art = _art(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("published_at", "id", "body_text"))).alias("b"))
    return art.select("cluster_id", X.combined_summary(F.transform("b", lambda x: x["body_text"])).alias("summary"))


@query("x_summary_context", f"{AS}, o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS n FROM art) SELECT cluster_id, left(string_agg(headline, '. ' ORDER BY n) FILTER (n <= 5) || ' ' || string_agg(snippet, ' ' ORDER BY n) FILTER (n <= 2), 700) AS context FROM o GROUP BY 1")
def x_summary_context(spark, d):
    rows = _art(spark, d).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("published_at", "id", "headline", "snippet"))).alias("a"))
    return rows.select("cluster_id", X.summary_context(F.transform("a", lambda x: x["headline"]), F.transform("a", lambda x: x["snippet"])).alias("context"))


@query("a_pipeline_stats", f"{AS} SELECT count(*)::BIGINT AS scraped, count(*) FILTER (bias = 'church_owned')::BIGINT AS new, count(DISTINCT cluster_id)::BIGINT AS clusters FROM art")
def a_pipeline_stats(spark, d):
    return _art(spark, d).agg(F.count("*").alias("scraped"), F.count_if(F.col("bias") == "church_owned").alias("new"), F.countDistinct("cluster_id").alias("clusters"))


@query("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    from ..streaming.refresh import counts_by_window

    return counts_by_window(table(spark, d, "events"))


@query("q_custom_publishers", f"{AS} SELECT DISTINCT 'own-' || publisher_id AS id, 'https://' || publisher_id AS rss_url FROM art")
def q_custom_publishers(spark, d):
    return _art(spark, d).select(F.concat(F.lit("own-"), "publisher_id").alias("id"), F.concat(F.lit("https://"), "publisher_id").alias("rss_url")).distinct().orderBy("id")


@query("src_get_publishers", f"{AS} SELECT publisher_id AS id, false AS is_global FROM pub UNION ALL SELECT DISTINCT 'own-' || publisher_id, true FROM art")
def src_get_publishers(spark, d):
    own = _art(spark, d).select(F.concat(F.lit("own-"), "publisher_id").alias("id"), F.lit(True).alias("is_global")).distinct()
    return publishers(spark).select("id", F.lit(False).alias("is_global")).unionByName(own)


@query("q_cluster_headlines", f"{AS} SELECT id, headline FROM art WHERE cluster_id = 'c3'")
def q_cluster_headlines(spark, d):
    return _art(spark, d).filter("cluster_id = 'c3'").select("id", "headline")


@query("q_body_cache", f"{AS} SELECT id, coalesce(nullif(image_url, ''), 'none') AS image_url FROM art WHERE body_text <> ''")
def q_body_cache(spark, d):
    return _art(spark, d).filter("body_text <> ''").select("id", X.nonempty(F.col("image_url"), F.lit("none")).alias("image_url"))


@query("q_ai_cache", f"{AS}, {CLUSTERS} SELECT id, 'h' AS ai_headline FROM cl WHERE is_blindspot")
def q_ai_cache(spark, d):
    c = _clusters(_art(spark, d))
    return C.cache_summary(c, c.filter("is_blindspot").select("id", F.lit("h").alias("ai_headline"), F.lit("s").alias("ai_summary"))).filter("ai_headline <> ''").select("id", "ai_headline")


@query("dml_wipe_all", f"{AS} SELECT name, count(*) FILTER (step = 'before')::BIGINT AS before, 0::BIGINT AS after FROM (SELECT 'articles' AS name, 'before' AS step FROM art UNION ALL SELECT 'clusters', 'before' FROM (SELECT DISTINCT cluster_id FROM art)) GROUP BY name")
def dml_wipe_all(spark, d):
    art = _art(spark, d)
    tables = {"articles": art, "clusters": _clusters(art)}
    gone = dict(zip(tables, C.wipe_all(*tables.values())))
    rows = None
    for name, df in tables.items():
        steps = df.select(F.lit(name).alias("name"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(gone[name].select(F.lit(name).alias("name"), F.lit(0).alias("b"), F.lit(1).alias("a")))
        rows = steps if rows is None else rows.unionByName(steps)
    return rows.groupBy("name").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


@query("dml_custom_pub_upsert", f"""{AS}, old AS (SELECT DISTINCT 'p' || (doc_id % 97) AS id, 'https://ex.com/' || (doc_id % 97) AS rss_url, '' AS name FROM art),
nw AS (SELECT 'p' || (doc_id * 5 // 8) AS id, 'https://ex.com/' || ((doc_id + 3) * 4 // 7) AS rss_url, id AS name, row_number() OVER (ORDER BY published_at, id) AS n FROM art),
last AS (SELECT *, max(n) OVER (PARTITION BY id) AS i, max(n) OVER (PARTITION BY rss_url) AS u FROM nw)
SELECT id, rss_url, name FROM old WHERE id NOT IN (SELECT id FROM nw) AND rss_url NOT IN (SELECT rss_url FROM nw) UNION ALL SELECT id, rss_url, name FROM last WHERE n = i AND n = u""")
def dml_custom_pub_upsert(spark, d):
    """Sources that replace those before them with the same id or the same address."""
    art = _art(spark, d)
    own = art.select(F.expr("concat('p', doc_id % 97)").alias("id"), F.expr("concat('https://ex.com/', doc_id % 97)").alias("rss_url"), F.lit("").alias("name")).distinct()
    new = art.select(F.expr("concat('p', doc_id * 5 div 8)").alias("id"), F.expr("concat('https://ex.com/', (doc_id + 3) * 4 div 7)").alias("rss_url"), F.col("id").alias("name"), "published_at")
    return C.upsert_publisher(own, new, "published_at", "name")


@query("dml_set_cluster", f"{AS} SELECT id, CASE WHEN bias = 'church_owned' THEN 'moved' ELSE cluster_id END AS cluster_id FROM art")
def dml_set_cluster(spark, d):
    art = _art(spark, d)
    return C.set_value(art, art.filter("bias = 'church_owned'").select("id", F.lit("moved").alias("cluster_id")), "cluster_id").select("id", "cluster_id")


@query("x_cluster_headline", f"{AS} SELECT cluster_id, coalesce((array_agg(headline ORDER BY published_at, id) FILTER (language = 'mt'))[1], nullif((array_agg(translated_headline ORDER BY published_at, id))[1], ''), (array_agg(headline ORDER BY published_at, id))[1]) AS headline FROM art GROUP BY 1")
def x_cluster_headline(spark, d):
    at = F.struct("published_at", "id")
    native = F.min_by("headline", F.when(F.col("language") == "mt", at))
    return _art(spark, d).groupBy("cluster_id").agg(F.coalesce(native, F.nullif(F.min_by("translated_headline", at), F.lit("")), F.min_by("headline", at)).alias("headline"))


@query("u_summarise", f"{AS} SELECT cluster_id, (array_agg(headline ORDER BY published_at, id))[1] AS headline, coalesce((array_agg(snippet ORDER BY published_at, id) FILTER (snippet <> ''))[1], '') AS summary FROM art GROUP BY 1")
def u_summarise(spark, d):
    at = F.struct("published_at", "id")
    return _art(spark, d).groupBy("cluster_id").agg(F.min_by("headline", at).alias("headline"), F.coalesce(F.min_by("snippet", F.when(F.col("snippet") != "", at)), F.lit("")).alias("summary"))


@query("f_category_gate", f"{AS}, {DOMINANT} SELECT id FROM art JOIN dc USING (cluster_id) WHERE dc.category = art.category OR dc.category = 'general' OR art.category = 'general'")
def f_category_gate(spark, d):
    art = _art(spark, d)
    return art.join(R.dominant_category(art).withColumnRenamed("category", "story_category"), "cluster_id").filter(Y.compatible(F.col("story_category"), F.col("category"))).select("id")


@query("k_limits", f"{AS} SELECT cluster_id, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at, id) AS n FROM art) WHERE n <= 5")
def k_limits(spark, d):
    return R.timeline(_art(spark, d)).filter("position <= 5").select("cluster_id", "id")
