"""Scalar functions and readers over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies, text, times, urls
from ..functions.vectors import evenly
from ..sinks import files as sinks
from .registry import query, table


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


CLOCK = """printf('%02d:%02d:%02d{dot}%03d', (floor({s}) / 3600)::BIGINT - CASE WHEN (floor({s}) / 3600)::BIGINT > floor({s}) / 3600 THEN 1 ELSE 0 END,
 (floor((floor({s})::BIGINT % 3600) / 60))::BIGINT, floor({s})::BIGINT % 60, round_even(({s} - floor({s})) * 1000, 0)::BIGINT)"""


@query(f"SELECT event_id, {CLOCK.format(s='(value * 37.7)', dot='.')} AS hms, {CLOCK.format(s='(value * 37.7)', dot=',')} AS srt FROM events")
def hms_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("value") * 37.7
    return table(spark, sf_dir, "events").select("event_id", times.hms(s).alias("hms"), times.srt(s).alias("srt"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN printf('%d:%02d:%02d,5', event_id % 7, event_id % 60, event_id % 59) WHEN 1 THEN printf('%d:%02d', event_id % 90, event_id % 60)
  WHEN 2 THEN printf('%d.25', event_id % 1000) ELSE 'x:1' END AS t FROM events)
SELECT event_id, t, CASE event_id % 4 WHEN 0 THEN (event_id % 7) * 3600.0 + (event_id % 60) * 60.0 + (event_id % 59) + 0.5 WHEN 1 THEN (event_id % 90) * 60.0 + event_id % 60 WHEN 2 THEN (event_id % 1000) + 0.25 END::DOUBLE AS seconds FROM t""")
def hms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    t = F.when(k % 4 == 0, F.format_string("%d:%02d:%02d,5", k % 7, k % 60, k % 59)).when(k % 4 == 1, F.format_string("%d:%02d", k % 90, k % 60)).when(k % 4 == 2, F.format_string("%d.25", k % 1000)).otherwise("x:1")
    return e.select("event_id", t.alias("t")).withColumn("seconds", times.seconds(F.col("t")))


@query("""WITH t AS (SELECT page_id, CASE page_id % 2 WHEN 0 THEN '00:01:05.5-00:02:00' ELSE '1:05–2' END AS r FROM pages)
SELECT page_id, 65.0 + CASE page_id % 2 WHEN 0 THEN 0.5 ELSE 0 END::DOUBLE AS start_s, CASE page_id % 2 WHEN 0 THEN 120.0 ELSE 2.0 END::DOUBLE AS end_s FROM t""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "00:01:05.5-00:02:00").otherwise("1:05–2").alias("r"))
    return p.withColumn("t", times.time_range(F.col("r"))).select("page_id", "t.start_s", "t.end_s")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
 nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '(\.[^./]+)$', 1)) AS ext FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.param(u, "page").alias("page"), urls.extension(F.regexp_extract(u, "^[^?#]*", 0)).alias("ext"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.substring(F.md5("url"), 1, 11), F.col("page_id") % 6
    c = (
        F.when(k == 0, F.concat(F.lit("see https://youtu.be/"), i, F.lit("?t=3).")))
        .when(k == 1, F.concat(F.lit("(https://www.youtube.com/watch?v="), i, F.lit("&t=3) and more")))
        .when(k == 2, F.concat(F.lit("https://www.youtube.com/embed/"), i, F.lit("/x")))
        .when(k == 3, F.concat(F.lit("https://example.com/watch?v="), i))
        .when(k == 4, F.concat(F.lit("https://www.youtube.com/about!")))
        .otherwise(F.lit("no link"))
    )
    return table(spark, sf_dir, "pages").select("page_id", i.alias("id"), c.alias("c"))


@query("SELECT page_id, CASE WHEN page_id % 6 < 3 THEN substr(md5(url), 1, 11) END AS video_id, page_id % 6 < 3 AND true AS ok FROM pages")
def video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = urls.video_id(F.col("c"))
    return _links(spark, sf_dir).select("page_id", v.alias("video_id"), urls.is_id(urls.clean_id(v)).alias("ok"))


@query(r"""SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def reply_text() -> F.Column:
    k, n = F.col("event_id") % 8, F.col("event_id").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit('{"correlated": true, "score": '), n, F.lit(', "reason": " x "}')))
        .when(k == 1, F.concat(F.lit('so {"correlated":"Yes","score":"72","reason":""} end '), n))
        .when(k == 2, F.lit('{"score": 80.7}'))
        .when(k == 3, F.lit('{"score": "80.7"}'))
        .when(k == 4, F.lit('{"score": null, "correlated": true}'))
        .when(k == 5, F.lit('{"score": {"v": 1}, "correlated": "Yes"}'))
        .when(k == 6, F.lit("Yes, score 1234"))
        .otherwise(F.lit(""))
    )


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS correlated,
 (CASE event_id % 8 WHEN 0 THEN least(event_id, 100) WHEN 1 THEN 72 WHEN 2 THEN 80 WHEN 3 THEN 80 WHEN 5 THEN 1 WHEN 6 THEN 100 ELSE 0 END)::INT AS score,
 CASE event_id % 8 WHEN 0 THEN 'x' WHEN 3 THEN '{"score": "80.7"}' WHEN 4 THEN '{"score": null, "correlated": true}' WHEN 5 THEN '{"score": {"v": 1}, "correlated": "Yes"}' WHEN 6 THEN 'Yes, score 1234' ELSE '' END AS reason FROM events""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", replies.score_reply(reply_text()).alias("r"))
    return e.select("event_id", "r.correlated", "r.score", "r.reason")


SPACE = r"[\s\p{Z}\x0B\x1C-\x1F]"


@query(rf"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 600 THEN s WHEN contains(left(s, 600), ' ') THEN regexp_replace(left(s, 600), ' [^ ]*$', '') || ' ...' ELSE left(s, 600) || ' ...' END AS summary FROM s""")
def summarize_600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summarise(F.col("text")).alias("summary"))


@query(rf"""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE regexp_replace(left(text, 1000), '{SPACE}+$', '') || ' …' END AS cut FROM documents""")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 1000).alias("cut"))


@query("SELECT doc_id, left(md5(text), 10) AS fingerprint FROM documents")
def fingerprint_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query(rf"""WITH p AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(q[i], '^{SPACE}+|{SPACE}+$', '', 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g') AS p FROM
 (SELECT doc_id, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT doc_id, string_split_regex(replace(replace(html, '<p>', chr(10) || chr(10)), chr(13) || chr(10), chr(10)), '\n{{2,}}') AS q FROM (SELECT page_id AS doc_id, html FROM pages))))
SELECT doc_id AS page_id, count(*) FILTER (p <> '')::BIGINT AS n, coalesce(string_agg(p, '|' ORDER BY i) FILTER (p <> ''), '') AS paragraphs FROM p GROUP BY doc_id""")
def paragraphise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", text.paragraphs(F.replace("html", F.lit("<p>"), F.lit("\n\n"))).alias("p"))
    return p.select("page_id", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("paragraphs"))


@query(rf"""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> ''))::BIGINT AS n_lines FROM documents""")
def nonempty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines"))


@query(r"""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g') AS safe, regexp_replace(url, '[\\/*?:"<>|]', '', 'g') AS file, printf('n%d_p%s_m%s', page_id, CASE page_id % 3 WHEN 0 THEN '0' ELSE (page_id % 3)::VARCHAR END, '6') AS tag FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = text.result_tag(F.col("page_id"), F.nullif(F.col("page_id") % 3, F.lit(0)), F.lit(6))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("safe"), text.safe_file(F.col("url")).alias("file"), tag.alias("tag"))


@query("""SELECT event_id, contains(lower(event_type || ' ' || props), 'click') OR contains(lower(event_type || ' ' || props), 'err') AS logical, event_type IN ('view', 'error') AS truth,
 CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'like' END AS sentiment, CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'dislike' END AS sentiment_fixed FROM events""")
def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", "I LIKE it").when(F.col("event_type") == "view", "dislike!").otherwise("neutral")
    truth = text.truthy(F.when(F.col("event_type") == "view", " Yes").when(F.col("event_type") == "error", "1").otherwise("no"))
    return e.select("event_id", text.any_keyword(F.concat_ws(" ", "event_type", "props"), ("click", "err")).alias("logical"), truth.alias("truth"), replies.sentiment(said).alias("sentiment"), replies.sentiment(said, compat=False).alias("sentiment_fixed"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n, CASE WHEN n <= 3 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_sort(list_distinct([round_even(i * (n - 1) / 2.0, 0)::INT FOR i IN range(0, 3)])), ',') END AS picks FROM n""")
def representative_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("conv_id", "n", F.array_join(evenly(F.col("n"), 3), ",").alias("picks"))


SEGMENTS = "SELECT conv_id, turn, text, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0 AS s FROM conversations"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: ten characters are a second."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").withColumn("start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / 10.0)
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), "start", (F.col("start") + F.length("text") / 10.0).alias("end"), F.coalesce("text", F.lit("")).alias("text"), "role")


@query(f"""WITH g AS ({SEGMENTS}) SELECT conv_id AS video_id, string_agg(printf('%d', turn + 1) || chr(10) || {CLOCK.format(s="s", dot=",")} || ' --> ' || {CLOCK.format(s="(s + n / 10.0)", dot=",")} || chr(10) || trim(text, ' ') || chr(10) || chr(10), '' ORDER BY turn) AS text FROM g GROUP BY conv_id""")
def srt_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.srt_txt(segments(spark, sf_dir))


@query(f"""WITH g AS ({SEGMENTS}) SELECT conv_id AS video_id, string_agg('[' || {CLOCK.format(s="s", dot=".")} || ' → ' || {CLOCK.format(s="(s + n / 10.0)", dot=".")} || '] ' || trim(text, ' ') || chr(10), '' ORDER BY turn) AS text FROM g GROUP BY conv_id""")
def timestamped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.timestamped_txt(segments(spark, sf_dir))
