"""Results, metrics, coverage, joins and lists over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import acquisition as acq, vector_index
from ..operators import coverage as cov
from ..operators import groups, intervals, metrics, opinions, retrieval
from ..sinks import report
from ..sources import files
from .registry import SQL, query, table

#: Events as candidates: the user is the video, the tenth of the value the unit, clicks and purchases correlate.
CANDIDATES = "SELECT user_id AS video_id, 'T' || (floor(value)::BIGINT % 7)::VARCHAR AS unit_id, event_id AS cand_idx, event_type IN ('click', 'purchase') AS correlated, floor(least(value, 100))::INT AS score, event_type AS reason, json_extract_string(props, '$.k') AS comment, 'u' || (event_id % 3)::VARCHAR AS url FROM events"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("video_id"), F.concat(F.lit("T"), (F.floor("value") % 7).cast("string")).alias("unit_id"), F.col("event_id").alias("cand_idx"), F.col("event_type").isin("click", "purchase").alias("correlated"),
        F.floor(F.least("value", F.lit(100))).cast("int").alias("score"), F.col("event_type").alias("reason"), F.get_json_object("props", "$.k").alias("comment"), F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("url"),
    )


@query(f"WITH c AS ({CANDIDATES}) SELECT video_id, round(avg(score), 6) AS corr_avg, median(score)::DOUBLE AS corr_median, count(score)::BIGINT AS corr_n, count_if(score >= 60)::BIGINT AS corr_n_over FROM c GROUP BY video_id")
def score_stats_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.score_stats(candidates(spark, sf_dir))
    return s.select("video_id", F.round("corr_avg", 6).alias("corr_avg"), F.col("corr_median").cast("double").alias("corr_median"), "corr_n", "corr_n_over")


@query(f"WITH c AS ({CANDIDATES}) SELECT video_id, count_if(score >= 60)::BIGINT AS over_threshold, count_if(score >= 60 AND correlated)::BIGINT AS correlated_over FROM c GROUP BY video_id")
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("video_id").agg(F.count_if(F.col("score") >= 60).alias("over_threshold"), F.count_if(cov.passes()).alias("correlated_over"))


@query(f"WITH c AS ({CANDIDATES}) SELECT video_id, count(DISTINCT nullif(trim(comment, ' '), ''))::BIGINT AS comments FROM c GROUP BY video_id")
def distinct_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_comments(candidates(spark, sf_dir))


SPINE = f"""WITH c AS ({CANDIDATES}), f AS (SELECT o_custkey AS video_id, count(*) AS frames FROM orders GROUP BY 1), w AS (SELECT doc_id AS video_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM documents),
s AS (SELECT video_id, avg(score) AS a, median(score) AS m, count(*) AS n, count_if(score >= 60) AS o FROM c GROUP BY 1), d AS (SELECT video_id, count(DISTINCT comment) AS k FROM c GROUP BY 1),
v AS (SELECT c_custkey AS video_id, coalesce(frames, 0)::BIGINT AS frames, coalesce(words, 0)::BIGINT AS transcript_words, coalesce(k, 0)::BIGINT AS comments, a AS corr_avg, m AS corr_median, coalesce(n, 0)::BIGINT AS corr_n, coalesce(o, 0)::BIGINT AS corr_n_over
 FROM customer LEFT JOIN f ON f.video_id = c_custkey LEFT JOIN w ON w.video_id = c_custkey LEFT JOIN s ON s.video_id = c_custkey LEFT JOIN d ON d.video_id = c_custkey)"""


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import word_count

    c = candidates(spark, sf_dir)
    frames = metrics.frame_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id")))
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), word_count(F.col("text")).alias("transcript_words"))
    return metrics.video_metrics(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), frames, words, metrics.distinct_comments(c), metrics.score_stats(c))


@query(SPINE + " SELECT video_id, frames, transcript_words, comments, round(corr_avg, 6) AS corr_avg, corr_median::DOUBLE AS corr_median, corr_n, corr_n_over FROM v")
def spine_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine(spark, sf_dir).withColumn("corr_avg", F.round("corr_avg", 6)).withColumn("corr_median", F.col("corr_median").cast("double"))


@query(SPINE + " SELECT 'all' AS label, count(*)::BIGINT AS num_videos, round(avg(frames), 6) AS avg_frames, round(avg(transcript_words), 6) AS avg_transcript_words, round(avg(comments), 6) AS avg_comments, round(avg(corr_avg), 6) AS avg_corr_avg, round(median(corr_avg), 6) AS median_corr_avg FROM v")
def set_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.set_aggregate(spine(spark, sf_dir).withColumn("topics", F.lit(0)), "all").drop("avg_topics")
    return a.select("label", "num_videos", *[F.round(c, 6).alias(c) for c in a.columns if c.startswith(("avg", "median"))])


@query(SPINE + """ SELECT video_id, 0 AS seq, 'row' AS kind, 0 AS level, concat_ws(chr(9), video_id::VARCHAR, frames::VARCHAR, transcript_words::VARCHAR, comments::VARCHAR, CASE WHEN corr_avg IS NULL THEN '—' ELSE printf('%.3f', corr_avg) END, CASE WHEN corr_median IS NULL THEN '—' ELSE printf('%.2f', corr_median) END) AS text FROM v""")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metrics_table(spine(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string"))).withColumn("video_id", F.col("video_id").cast("long"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS video_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id)::VARCHAR AS last_value FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT c_custkey::VARCHAR AS video_id, c_mktsegment AS segment, last_type, last_value::DOUBLE AS last_value FROM customer LEFT JOIN e ON e.video_id = c_custkey::VARCHAR""")
def extra_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), F.col("c_mktsegment").alias("segment"))
    extra = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"), F.col("event_type").alias("segment"))
    return metrics.with_extra(base, extra, "event_id", ["segment", "last_type", "last_value", "absent"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines as text: every event one record, some repeated, some broken, some blank."""
    c = candidates(spark, sf_dir)
    cand = F.array(F.struct("correlated", "score", "reason", "comment", "url"))
    good = F.to_json(F.struct(F.col("video_id").cast("string").alias("video_id"), F.col("unit_id").alias("topic_id"), F.lit("t").alias("title"), F.lit(1).alias("checked_pairs"), cand.alias("candidates")))
    k = F.col("cand_idx") % 11
    return c.select(F.lit("f").alias("file"), F.col("cand_idx").alias("line"), F.when(k == 0, F.substring(good, 1, 20)).when(k == 1, "").when(k == 2, "[1]").otherwise(good).alias("value"))


LATEST = f"WITH c AS ({CANDIDATES}), l AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY cand_idx DESC) AS n FROM c WHERE cand_idx % 11 > 2)"


@query(LATEST + " SELECT video_id::VARCHAR AS video_id, unit_id, correlated, score::DOUBLE AS score, reason, comment, url FROM l WHERE n = 1")
def results_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.candidates(files.latest(files.result_lines(records(spark, sf_dir)))).select("video_id", "unit_id", "correlated", "score", "reason", "comment", "url")


@query(f"WITH c AS ({CANDIDATES}) SELECT video_id::VARCHAR AS video_id, count(*)::BIGINT AS total_pairs FROM c WHERE cand_idx % 11 > 2 GROUP BY video_id")
def total_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.total_pairs(files.result_lines(records(spark, sf_dir)))


@query(f"WITH c AS ({CANDIDATES}), g AS (SELECT video_id, reason AS file, count(*) AS n, count(score) AS k FROM c GROUP BY 1, 2) SELECT video_id, file FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, k DESC, file DESC) AS r FROM g) WHERE r = 1")
def best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.best_file(candidates(spark, sf_dir).withColumn("file", F.col("reason")))


LAST = f"WITH c AS ({CANDIDATES}), l AS (SELECT video_id, url, comment, unit_id, arg_max(correlated, cand_idx) AS correlated, arg_max(score, cand_idx) AS score FROM c GROUP BY 1, 2, 3, 4), p AS (SELECT *, correlated AND score >= 60 AS ok FROM l)"


@query(LAST + " SELECT video_id, url, comment, count_if(ok)::BIGINT AS n_units, coalesce(max(score) FILTER (ok), 0)::INT AS max_score, coalesce(string_agg(unit_id || ':' || score::VARCHAR, ',' ORDER BY unit_id) FILTER (ok), '') AS units FROM p GROUP BY 1, 2, 3")
def coverage_per_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cov.coverage(candidates(spark, sf_dir))
    units = F.array_join(F.transform(F.map_entries("per_unit"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["score"].cast("string"))), ",")
    return c.select("video_id", "url", "comment", "n_units", "max_score", units.alias("units"))


@query(LAST + """, g AS (SELECT video_id, url, comment, count_if(ok) AS n FROM p GROUP BY 1, 2, 3), a AS (SELECT video_id, count(*) AS k FROM c GROUP BY 1)
SELECT g.video_id, count_if(n > 0)::BIGINT AS n_correlated, any_value(k)::BIGINT AS n_available, round(100.0 * count_if(n > 0) / any_value(k), 6)::DOUBLE AS percent FROM g JOIN a USING (video_id) GROUP BY g.video_id""")
def coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return cov.coverage_summary(cov.coverage(c), c).withColumn("percent", F.round("percent", 6))


@query(LAST + """, t AS (SELECT *, row_number() OVER (PARTITION BY video_id, url, comment ORDER BY score DESC, unit_id DESC) AS d, row_number() OVER (PARTITION BY video_id, url, comment ORDER BY score, unit_id) AS u FROM p WHERE ok)
SELECT video_id, url, comment, unit_id, score, d::INT AS rank, 'top' AS side FROM t WHERE d <= 2 UNION ALL SELECT video_id, url, comment, unit_id, score, u::INT, 'bottom' FROM t WHERE u <= 2""")
def units_per_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.units_per_comment(cov.coverage(candidates(spark, sf_dir)), 2).select("video_id", "url", "comment", "unit_id", "score", "rank", "side")


RANKING = f"WITH c AS ({CANDIDATES}), u AS (SELECT DISTINCT video_id, unit_id, 'title ' || unit_id AS title FROM c), g AS (SELECT u.video_id, u.unit_id, title, coalesce(avg(score) FILTER (correlated AND score >= 60), 0.0) AS a, count(*) FILTER (correlated AND score >= 60) AS n FROM u JOIN c ON c.video_id = u.video_id AND c.unit_id = u.unit_id GROUP BY 1, 2, 3)"


def unit_titles(c: DataFrame) -> DataFrame:
    return c.select("video_id", "unit_id", F.concat(F.lit("title "), "unit_id").alias("title")).distinct()


@query(RANKING + """, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a DESC, title DESC, unit_id DESC) AS d, row_number() OVER (PARTITION BY video_id ORDER BY a, title, unit_id) AS u FROM g)
SELECT video_id, unit_id, title, round(a, 6) AS avg_score, n::BIGINT AS contributions, d::INT AS rank, 'top' AS side FROM r WHERE d <= 3 UNION ALL SELECT video_id, unit_id, title, round(a, 6), n::BIGINT, u::INT, 'bottom' FROM r WHERE u <= 3""")
def rank_topics_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return cov.top_units(cov.unit_ranking(unit_titles(c), c)).withColumn("avg_score", F.round("avg_score", 6))


@query(f"WITH c AS ({CANDIDATES}) SELECT video_id, unit_id, cand_idx, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY score DESC, cand_idx) AS rank FROM c WHERE correlated AND score >= 60) WHERE rank <= 5")
def keep_topk_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.kept_comments(candidates(spark, sf_dir)).select("video_id", "unit_id", "cand_idx", "score", "rank")


#: The report's blocks as ``numbered``.
REPORT = LAST + f""", g AS (SELECT video_id, url, comment, count_if(ok) AS n, coalesce(max(score) FILTER (ok), 0) AS best FROM p GROUP BY 1, 2, 3), t AS (SELECT video_id, count(*) AS total FROM c GROUP BY 1),
h AS (SELECT t.video_id, total, k, round(100.0 * k / total, 1) AS pc FROM t JOIN (SELECT video_id, count_if(n > 0) AS k FROM g GROUP BY 1) USING (video_id)),
cov AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, best DESC, comment DESC, url) AS i FROM g),
un AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY unit_id) AS i FROM (SELECT DISTINCT video_id, unit_id, 'title ' || unit_id AS title FROM c)),
av AS (SELECT video_id, un.unit_id, title, coalesce(a, 0.0) AS a, coalesce(m, 0) AS m FROM un LEFT JOIN (SELECT video_id, unit_id, avg(score) AS a, count(*) AS m FROM c WHERE correlated AND score >= 60 GROUP BY 1, 2) USING (video_id, unit_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a DESC, title DESC, unit_id DESC) AS d, row_number() OVER (PARTITION BY video_id ORDER BY a, title, unit_id) AS u FROM av),
kc AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY score DESC, cand_idx) AS rank FROM c WHERE correlated AND score >= 60),
blocks AS (SELECT video_id, 0 AS part, '0' AS pos, 'heading' AS kind, 1 AS level, 'Correlation report: ' || video_id::VARCHAR AS text FROM t
 UNION ALL SELECT video_id, 1, '0', 'paragraph', 0, 'Pairs checked: ' || total::VARCHAR || '; comments with a match: ' || k::VARCHAR || ' (' || printf('%.1f', pc) || '%)' FROM h
 UNION ALL SELECT video_id, 2, lpad(i::VARCHAR, 9, '0'), 'bullet', 0, n::VARCHAR || ' units, best ' || best::VARCHAR || ': ' || comment FROM cov
 UNION ALL SELECT video_id, 3, 'a' || lpad(d::VARCHAR, 9, '0'), 'bullet', 0, 'top ' || d::VARCHAR || ': ' || title || ' ' || printf('%.2f', round(a, 2)) || ' over ' || m::VARCHAR FROM rk WHERE d <= 3
 UNION ALL SELECT video_id, 3, 'b' || lpad(u::VARCHAR, 9, '0'), 'bullet', 0, 'bottom ' || u::VARCHAR || ': ' || title || ' ' || printf('%.2f', round(a, 2)) || ' over ' || m::VARCHAR FROM rk WHERE u <= 3
 UNION ALL SELECT video_id, 4, lpad(i::VARCHAR, 9, '0'), 'heading', 2, title FROM un
 UNION ALL SELECT video_id, 4, lpad(i::VARCHAR, 9, '0') || '/' || lpad(rank::VARCHAR, 9, '0'), 'bullet', 0, '[' || score::VARCHAR || '] ' || comment || ' - ' || reason FROM kc JOIN un USING (video_id, unit_id) WHERE rank <= 5),
numbered AS (SELECT video_id::VARCHAR AS video_id, row_number() OVER (PARTITION BY video_id ORDER BY part, pos) - 1 AS seq, kind, level, text FROM blocks)"""


@query(REPORT + " SELECT video_id, seq::INT AS seq, kind, level::INT AS level, text FROM numbered")
def correlation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string"))
    units = unit_titles(c).withColumn("pos", F.col("unit_id"))
    return report.correlation_report(units, c, c.withColumn("checked_pairs", F.lit(1)), c)


# --- joins


@query("""WITH v AS (SELECT DISTINCT source AS video_id FROM documents UNION ALL SELECT 'none'), own AS (SELECT v.video_id, doc_id FROM v JOIN documents d ON d.source = v.video_id AND d.lang = 'en'),
a AS (SELECT *, false AS fallback FROM own UNION ALL SELECT v.video_id, doc_id, true FROM v, documents d WHERE d.lang = 'en' AND v.video_id NOT IN (SELECT source FROM documents WHERE lang = 'en'))
SELECT video_id, fallback, count(*)::BIGINT AS n, min(doc_id) AS first, max(doc_id) AS last FROM a GROUP BY 1, 2""")
def fallback_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    videos = d.select(F.col("source").alias("video_id")).distinct().unionByName(spark.createDataFrame([("none",)], "video_id string"))
    c = d.where("lang = 'en'").select(F.col("source").alias("video_id"), "doc_id")
    return retrieval.comments_of(videos, c).groupBy("video_id", "fallback").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id, row_id, round(list_dot_product(q.e, r.e), 6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, r.e) DESC, row_id) AS rank FROM q, r)
SELECT vec_id, row_id, sim, rank::INT AS rank FROM s WHERE rank <= 10""")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # the stated query set: every id divisible by 100
    found = retrieval.top_k_of_vectors(e.where("vec_id % 100 = 0"), e.withColumnRenamed("vec_id", "row_id"), 10, "vec_id", "row_id", "embedding")
    return found.withColumn("sim", F.round("sim", 6))


@query(SQL["topk_cosine"])
def topk_cosine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of cells, of which bounds rule out those that cannot hold a better row."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e.select(F.col("vec_id").alias("row_id"), "embedding"), "row_id", "embedding")
    found = vector_index.exact(index, e.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")
    return found.select("vec_id", "row_id", F.round("sim", 6).alias("sim"), "rank")


@query("SELECT count(*)::BIGINT AS queries, sum(least(n, 10))::BIGINT AS wanted, true AS reached, true AS fewer_rows FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes widened until 0.95 of the ten nearest rows are found, and whether that compares fewer rows than all."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select("vec_id", "embedding")
    index = vector_index.build(e.select(F.col("vec_id").alias("row_id"), "embedding"), "row_id", "embedding")
    probes, share = vector_index.calibrate(index, q, 10, "vec_id", "embedding")
    own = vector_index.probed(index, vector_index.asked(q, "vec_id", "embedding"), "vec_id", vector_index.nearest_cells(probes))
    compared = own.join(index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell").agg(F.sum("n").alias("compared"))
    wanted = e.agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("each"), F.count(F.lit(1)).alias("n"))
    return q.agg(F.count(F.lit(1)).alias("queries")).join(wanted).join(compared).select("queries", (F.col("queries") * F.col("each")).alias("wanted"), F.lit(share >= 0.95).alias("reached"), (F.col("compared") < F.col("queries") * F.col("n")).alias("fewer_rows"))


@query("""WITH e AS (SELECT vec_id, 'v' || label::VARCHAR AS video_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.video_id, a.vec_id AS unit_id, b.vec_id AS comment_idx, round(list_dot_product(a.e, b.e), 6) AS sim FROM e a JOIN e b ON a.video_id = b.video_id)
SELECT video_id, unit_id, comment_idx, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY sim DESC, comment_idx) AS rank FROM s) WHERE rank <= 5""")
def topk_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar comments of each unit among those of its video."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), "vec_id", "embedding")
    found = retrieval.top_k(e.withColumnsRenamed({"vec_id": "unit_id", "embedding": "unit_vec"}), e.withColumnsRenamed({"vec_id": "comment_idx", "embedding": "comment_vec"}), 5)
    return found.select("video_id", "unit_id", "comment_idx", F.round("sim", 6).alias("sim"), "rank")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("unit_id"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"))
    return retrieval.unfinished(units, done, ("unit_id",)).select(F.col("unit_id").alias("doc_id"))


@query("SELECT video_id, bool_or(k = 1) AS plain, bool_or(k = 2) AS stamped, bool_or(k = 3) AS topics FROM (SELECT doc_id AS video_id, 1 AS k FROM documents UNION ALL SELECT doc_id, 2 FROM labels UNION ALL SELECT item_id, 3 FROM benchmark) GROUP BY 1")
def full_outer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("video_id"))
    return acq.id_union(("plain", ids("documents", "doc_id")), ("stamped", ids("labels", "doc_id")), ("topics", ids("benchmark", "item_id")))


@query("""WITH a AS (SELECT conv_id AS video_id, turn // 2 AS frame, text AS caption FROM conversations WHERE role = 'user'), b AS (SELECT conv_id AS video_id, turn // 2 AS frame, text AS caption FROM conversations WHERE role = 'assistant')
SELECT a.video_id, a.frame, a.caption AS caption_a, b.caption AS caption_b FROM a JOIN b ON a.video_id = b.video_id AND a.frame = b.frame
WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.video_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.video_id AND l.toxic = a.frame)""")
def inner_caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    own = lambda r: c.where(F.col("role") == r).select(F.col("conv_id").alias("video_id"), F.floor(F.col("turn") / 2).alias("frame"), F.col("text").alias("caption"))
    a = own("user")
    disk = a.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), "video_id").select("video_id", "frame")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), F.col("toxic").cast("long").alias("frame"))
    return groups.merge_captions(a, own("assistant"), disk, done)


# --- lists


@query("SELECT url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND q.url = p.url) AND NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 5 = 0 AND q.url = p.url)")
def except_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return acq.remaining(p, p.where("page_id % 3 = 0"), p.where("page_id % 5 = 0")).select("url")


@query("SELECT page_id AS seq, url, rn::INT AS rn, ((rn - 1) // 15)::BIGINT AS batch_id FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS rn FROM pages) WHERE rn <= 100")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acq.batches(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url"), "seq")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acq.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT page_id, url, rn::BIGINT AS rn, ((rn - 1) // (n // 7 + 1))::BIGINT AS bucket FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS rn, count(*) OVER () AS n FROM pages)")
def url_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acq.url_buckets(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 7)


@query("SELECT source, doc_id, rn::INT AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10")
def capped_per_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acq.capped(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10)


def attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A first pass, and a second over what it left; ids of odd pages have a file, those divisible by 4 by then."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://youtu.be/p"), F.col("page_id").cast("string"), F.lit("?t=1")).alias("url"), "page_id")
    stem = F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("stem")
    first = acq.outcomes(p, p.where("page_id % 2 = 1").select(stem))
    return first, acq.outcomes(acq.retry_queue(first).drop("video_id"), p.where("page_id % 4 = 0").select(stem), retried=True)


@query("SELECT page_id, 'p' || page_id::VARCHAR AS video_id, CASE WHEN page_id % 4 = 0 THEN 'downloaded' ELSE 'failed' END AS outcome FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'p' || page_id::VARCHAR, 'downloaded' FROM pages WHERE page_id % 2 = 1")
def download_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = attempts(spark, sf_dir)
    return first.where("outcome = 'downloaded'").unionByName(second).select("page_id", "video_id", "outcome")


@query("SELECT count(*)::BIGINT AS attempted, count_if(page_id % 2 = 1 OR page_id % 4 = 0)::BIGINT AS ok, count_if(page_id % 4 = 2)::BIGINT AS failed FROM pages")
def download_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = attempts(spark, sf_dir)
    return acq.totals(first.where("outcome = 'downloaded'").unionByName(second))


@query("SELECT c_custkey::VARCHAR AS video_id, 'https://www.youtube.com/watch?v=' || c_custkey::VARCHAR AS url, t.event_type AS title FROM customer LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1) t ON t.user_id = c_custkey")
def lookup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("video_id"))
    t = table(spark, sf_dir, "events").select(urls.watch_url(F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("title"))
    return acq.lookup_by_url(v, t).select("video_id", "url", "title")


@query("SELECT n.n_name AS video_id, min(m.n_name) AS name FROM nation n LEFT JOIN (SELECT n_name || '.mp4' AS n_name FROM nation UNION ALL SELECT n_name || '-2.mp4' FROM nation) m ON starts_with(m.n_name, n.n_name) GROUP BY n.n_name")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("video_id"))
    f = n.select(F.concat("video_id", F.lit(".mp4")).alias("name")).unionByName(n.select(F.concat("video_id", F.lit("-2.mp4")).alias("name")))
    return intervals.prefix_lookup(n, f).select("video_id", "name")


# --- opinions


def opinion_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type").isin("click", "view"), "I like it").when(F.col("event_type") == "error", "dislike").otherwise("neutral")
    body = F.when(F.col("event_id") % 3 == 0, "Yes: hand movement").when(F.col("event_id") % 3 == 1, "No").otherwise("well yes")
    return e.select(F.col("user_id").alias("link"), F.col("event_id").alias("seq"), said.alias("sentiment_reply"), F.concat(F.lit(" Clear "), "event_type").alias("reason_reply"), body.alias("embodied_reply"), F.when(F.col("event_id") % 2 == 0, "They reasoned well").otherwise("no").alias("logical_reply"), F.when(F.col("event_id") % 5 == 0, "Hands-on").otherwise("none").alias("logical_embodied_reply"), F.lit("other").alias("other_reply"))


@query("""SELECT user_id AS link, count(*)::BIGINT AS opinions, count_if(event_type IN ('click', 'view', 'error'))::BIGINT AS "like", 0::BIGINT AS dislike, count_if(event_type IN ('click', 'view', 'error') AND event_id % 3 <> 1)::BIGINT AS embodied_like,
 0::BIGINT AS embodied_dislike, count_if(event_id % 2 = 0)::BIGINT AS logical, count_if(event_id % 10 = 0)::BIGINT AS logical_embodied FROM events GROUP BY user_id""")
def sentiment_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.label_counts(opinions.label(opinion_replies(spark, sf_dir)))


@query("""WITH g AS (SELECT user_id AS link, 'clear ' || event_type AS reason, count(*)::BIGINT AS n, min(event_id) AS first_seq FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY link ORDER BY n DESC, first_seq)::INT AS rank FROM g""")
def most_common_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.reason_counts(opinions.label(opinion_replies(spark, sf_dir)))


# --- flagship


LEXICAL = r"""WITH t AS (SELECT item_id, 'src' || (item_id % 20)::VARCHAR AS video_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
c AS (SELECT doc_id, source AS video_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
p AS (SELECT t.video_id, item_id, doc_id, len(list_intersect(t.w, c.w)) AS k, len(t.w) + len(c.w) AS s FROM t JOIN c ON t.video_id = c.video_id),
q AS (SELECT *, floor(100 * CASE WHEN s - k = 0 THEN 0 ELSE k::DOUBLE / (s - k) END)::INT AS score FROM p)"""


def lexical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("video_id"), "item_id", F.col("text").alias("unit_text"))
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id", F.col("text").alias("comment"))
    # word sets are made once a row, before the pairs
    from ..functions.text import word_keys
    from ..functions.vectors import jaccard

    pairs = retrieval.pairs(t.withColumn("tw", word_keys(F.col("unit_text"))).drop("unit_text"), c.withColumn("cw", word_keys(F.col("comment"))).drop("comment"))
    return pairs.select("video_id", "item_id", "doc_id", F.floor(100 * jaccard(F.col("cw"), F.col("tw"))).cast("int").alias("score"))


@query(LEXICAL + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM q)
SELECT video_id, item_id, count(*)::BIGINT AS checked_pairs, max(score) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5) AS top_docs FROM r GROUP BY video_id, item_id""")
def lexical_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: topics against their video's comments, scored by words, summed up by topic."""
    from pyspark.sql import Window

    # every comment of the video is checked, so the pairs are counted without scoring them again
    checked = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("video_id")).agg(F.count(F.lit(1)).alias("checked_pairs"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = lexical_pairs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    docs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    top = ranked.groupBy("video_id", "item_id").agg(F.max("score").alias("best"), docs.alias("top_docs"))
    return top.join(checked, "video_id").select("video_id", "item_id", "checked_pairs", "best", "top_docs")


def vector_sql(text: str) -> str:
    """The unit vector of a text's hashed words, as ``scorers.embed`` makes it."""
    h = rf"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: ('0x' || md5(w)[1:8])::BIGINT)"
    return f"list_transform(range(64), lambda d: list_sum(list_transform(list_filter({h}, lambda x: x % 64 = d), lambda x: CASE WHEN x >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)))"


def unit_sql(v: str) -> str:
    norm = f"sqrt(list_sum(list_transform({v}, lambda x: coalesce(x, 0) * coalesce(x, 0))))"
    return f"list_transform({v}, lambda x: (coalesce(x, 0) / CASE WHEN {norm} > 0 THEN {norm} ELSE 1 END)::FLOAT::DOUBLE)"


RETRIEVED = LEXICAL + rf""", te AS (SELECT video_id, item_id::VARCHAR AS unit_id, {unit_sql("v")} AS e, w FROM (SELECT 'src' || (item_id % 20)::VARCHAR AS video_id, item_id, {vector_sql(r"regexp_replace(text, '^[\s]+|[\s]+$', '', 'g')")} AS v, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark)),
ce AS (SELECT video_id, doc_id, {unit_sql("v")} AS e, w FROM (SELECT source AS video_id, doc_id, {vector_sql("text")} AS v, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents)),
own AS (SELECT video_id, doc_id, video_id AS src FROM ce UNION ALL SELECT t.video_id, doc_id, ce.video_id FROM (SELECT DISTINCT video_id FROM te) t, ce WHERE t.video_id NOT IN (SELECT video_id FROM ce)),
sm AS (SELECT te.video_id, unit_id, own.src, ce.doc_id, te.w AS tw, ce.w AS cw, round(list_sum(list_transform(range(1, 65), lambda d: te.e[d] * ce.e[d])), 6) AS sim FROM te JOIN own ON own.video_id = te.video_id JOIN ce ON ce.doc_id = own.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY sim DESC, src, doc_id) AS rank FROM sm),
sc AS (SELECT *, len(list_intersect(tw, cw)) AS k, len(tw) + len(cw) AS s FROM rk WHERE rank <= 10)
SELECT video_id, unit_id, doc_id AS comment_idx, floor(100 * CASE WHEN s - k = 0 THEN 0 ELSE k::DOUBLE / (s - k) END)::INT AS score, floor(100 * CASE WHEN s - k = 0 THEN 0 ELSE k::DOUBLE / (s - k) END) >= 60 AS correlated, rank::INT AS rank FROM sc"""


@query(RETRIEVED)
def retrieval_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval by embeddings before scoring: the ten most similar comments of each topic, then words."""
    from . import pipelines

    t = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("video_id"), F.col("item_id").cast("string").alias("unit_id"), F.lit("").alias("title"), F.col("text").alias("description"))
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("comment_idx"), F.col("text").alias("comment"), F.lit("").alias("url"))
    videos = t.select("video_id").distinct()
    return pipelines.correlate(videos, t, c, k=10).select("video_id", "unit_id", "comment_idx", "score", "correlated", "rank")

