"""Blocks, chunks, intervals, groups, sections over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import join_ordered
from ..operators import blocks, chunks, groups, intervals, sections
from .registry import SQL, query, table
from .text_queries import SEGMENTS, segments


@query("""WITH b AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, block::BIGINT AS block, count(*)::BIGINT AS n, string_agg(text, ' ' ORDER BY turn) AS joined FROM b WHERE block > 0 GROUP BY conv_id, block""")
def block_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.islands(table(spark, sf_dir, "conversations"), F.col("role") == "user", ["conv_id"], "turn").where("block > 0")
    return b.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), join_ordered(F.collect_list(F.struct("turn", "text"))).alias("joined"))


PARAS = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'https://www.youtube.com/watch?v=' || left(md5(conv_id::VARCHAR || '/' || turn::VARCHAR), 11) || ' intro' ELSE trim(text, ' ') END AS p, role FROM conversations"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a user's turn is a link, the others are text."""
    link = F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 11), F.lit(" intro"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("para_no"), F.lit("").alias("style"), F.when(F.col("role") == "user", link).otherwise(F.trim("text")).alias("text"))


@query(rf"""WITH p AS ({PARAS}), b AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM p),
g AS (SELECT conv_id, block, max(p) FILTER (role = 'user') AS url, string_agg(regexp_replace(p, '^\s+|\s+$', '', 'g'), ' ' ORDER BY turn) FILTER (role <> 'user') AS comment FROM b WHERE block > 0 GROUP BY conv_id, block)
SELECT conv_id::VARCHAR AS doc, block::BIGINT AS comment_idx, regexp_extract(url, 'v=(\w+)', 1) AS video_id, url, comment FROM g WHERE comment <> ''""")
def comment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.comments(paragraphs(spark, sf_dir))


@query(rf"""WITH p AS ({PARAS}), f AS (SELECT *, last_value(CASE role WHEN 'user' THEN regexp_extract(p, '^\S+') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS link FROM p)
SELECT conv_id::VARCHAR AS doc, link, turn::INT AS seq, regexp_replace(p, '^\s+|\s+$', '', 'g') AS paragraph FROM f WHERE role <> 'user' AND link IS NOT NULL AND p <> ''""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.opinions(paragraphs(spark, sf_dir))


@query(f"WITH p AS ({PARAS}) SELECT conv_id::VARCHAR AS doc, turn::INT AS para_no, 0 AS k, regexp_extract(p, '^\\S+') AS link FROM p WHERE role = 'user'")
def link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.links(paragraphs(spark, sf_dir))


def caption_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    name = F.format_string("frame_%04d.jpg", (F.col("turn") / 4).cast("int"))
    return c.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("para_no"), F.when(F.col("turn") % 2 == 0, "Heading1").otherwise("").alias("style"), F.when(F.col("turn") % 2 == 0, name).when(F.col("turn") % 4 == 1, F.concat(F.lit("Description: "), F.trim("text"))).otherwise(F.concat(F.lit("Caption: "), F.trim("text"))).alias("text"))


@query(r"""WITH b AS (SELECT conv_id, turn, turn // 2 AS block, turn % 2 = 0 AS head, printf('frame_%04d.jpg', turn // 4) AS frame, trim(text, ' ') AS t FROM conversations),
g AS (SELECT conv_id, block, max(frame) AS frame, coalesce(' ' || string_agg(CASE WHEN turn % 4 = 1 THEN 'Description: ' ELSE 'Caption: ' END || regexp_replace(t, '\s+$', ''), ' ' ORDER BY turn) FILTER (NOT head), '') AS caption FROM b GROUP BY conv_id, block HAVING bool_or(head))
SELECT conv_id::VARCHAR AS doc, frame, arg_max(caption, block) AS caption FROM g GROUP BY conv_id, frame""")
def caption_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.caption_map(caption_paragraphs(spark, sf_dir))


@query("""WITH b AS (SELECT conv_id, turn, printf('frame_%04d.jpg', turn // 4) AS frame, turn % 2 = 0 AS head, bool_or(turn % 4 = 1) OVER w AND bool_or(turn % 4 = 3) OVER w AS ok FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT DISTINCT conv_id::VARCHAR AS doc, frame FROM b WHERE head AND ok""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.processed_frames(caption_paragraphs(spark, sf_dir), validate=5)


@query(f"""WITH RECURSIVE g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, length(trim(text, ' ' || chr(10) || chr(9))) + 30 AS n, s, s + n / 10.0 AS e FROM ({SEGMENTS})),
c AS (SELECT conv_id, turn, rn, 0 AS chunk, s AS first, n + 1 AS chars FROM g WHERE rn = 1 UNION ALL
 SELECT g.conv_id, g.turn, g.rn, CASE WHEN g.e - c.first > 60 OR c.chars + g.n + 1 > 1200 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN g.e - c.first > 60 OR c.chars + g.n + 1 > 1200 THEN g.s ELSE c.first END,
 CASE WHEN g.e - c.first > 60 OR c.chars + g.n + 1 > 1200 THEN g.n + 1 ELSE c.chars + g.n + 1 END FROM c JOIN g ON g.conv_id = c.conv_id AND g.rn = c.rn + 1)
SELECT conv_id AS video_id, turn::INT AS seg_idx, chunk::INT AS chunk_index FROM c""")
def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_segments(segments(spark, sf_dir), 60.0, 1200).select("video_id", "seg_idx", "chunk_index")


@query("""WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, length(text) + 1 AS len FROM conversations),
t AS (SELECT conv_id, coalesce(sum(len) FILTER (trim(text, ' ') <> ''), 1) - 1 AS total, count(*) AS cnt FROM l GROUP BY conv_id),
s AS (SELECT conv_id, total, cnt, greatest(2, floor(total / 800.0)::INT) AS first, cnt AS cap FROM t WHERE total > 800),
c AS (SELECT conv_id, unnest(range(first, greatest(first, cap) + 1)) AS step, greatest(first, cap) AS last FROM s),
f AS (SELECT c.conv_id, c.step, any_value(c.last) AS last, sum(len) - 1 AS size FROM c JOIN l ON l.conv_id = c.conv_id AND l.n % c.step = 0 GROUP BY c.conv_id, c.step),
p AS (SELECT conv_id, coalesce(min(step) FILTER (size <= 800), any_value(last)) AS step FROM f GROUP BY conv_id)
SELECT l.conv_id AS video_id, l.turn::INT AS seg_idx FROM l LEFT JOIN p ON p.conv_id = l.conv_id WHERE CASE WHEN p.step IS NULL THEN trim(l.text, ' ') <> '' ELSE l.n % p.step = 0 END""")
def thin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.thin_lines(segments(spark, sf_dir).withColumn("line", F.col("text")), 800).select("video_id", "seg_idx")


@query(f"""SELECT conv_id AS video_id, turn::INT AS seg_idx, printf('[S%05d] ', turn) || text AS line FROM ({SEGMENTS})""")
def segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.number_segments(segments(spark, sf_dir)).select("video_id", "seg_idx", "line")


@query("SELECT event_id AS frame_no, (event_id // 100)::INT AS saved_idx, printf('frame_%04d.jpg', event_id // 100) AS frame FROM events WHERE event_id % 100 = 0")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sample_frames(table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_no")))


@query("""WITH f AS (SELECT conv_id, printf('frame_%04d.jpg', turn) AS frame, text, row_number() OVER (PARTITION BY conv_id ORDER BY printf('frame_%04d.jpg', turn)) - 1 AS n FROM conversations)
SELECT a.conv_id AS video_id, a.n::INT AS first, a.frame || '+' || b.frame || '+' || c.frame AS group_id,
 'Frame 1 (' || a.frame || '): ' || a.text || chr(10) || 'Frame 2 (' || b.frame || '): ' || b.text || chr(10) || 'Frame 3 (' || c.frame || '): ' || c.text AS combined_caption
FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.n = a.n + 1 JOIN f c ON a.conv_id = c.conv_id AND c.n = a.n + 2""")
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.format_string("frame_%04d.jpg", "turn").alias("frame"), F.col("text").alias("caption"))
    return groups.frame_groups(f, 3).select("video_id", "first", "group_id", "combined_caption")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
i AS (SELECT *, sum((far IS NULL OR s > far + 2.0)::INT) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM m)
SELECT user_id, island::BIGINT AS island, min(s) AS start_s, max(e) AS end_s, count(*)::BIGINT AS n FROM i GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = table(spark, sf_dir, "events").select("user_id", s.alias("start_s"), (s + F.col("value")).alias("end_s"))
    return intervals.merge_intervals(e, ["user_id"], "start_s", "end_s", 2.0)


@query("""WITH r AS (SELECT l_suppkey, greatest(0, least(39, least(l_quantity::INT, l_linenumber * 6))) AS a, greatest(0, least(39, greatest(l_quantity::INT, l_linenumber * 6))) AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
i AS (SELECT *, sum((far IS NULL OR a > far + 1)::INT) OVER (PARTITION BY l_suppkey ORDER BY a, b) AS island FROM m)
SELECT l_suppkey, min(a) AS start_idx, max(b) AS end_idx, count(*)::BIGINT AS n FROM i GROUP BY l_suppkey, island""")
def index_range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("start_idx"), (F.col("l_linenumber") * 6).alias("end_idx"), F.lit(40).alias("size"))
    return intervals.merge_ranges(r, ["l_suppkey"], size="size").drop("island")


@query("""WITH r AS (SELECT conv_id, min(turn) AS a, max(turn) // 2 AS b FROM conversations GROUP BY conv_id)
SELECT r.conv_id AS video_id, a::INT AS start_idx, b::INT AS end_idx, count(c.turn)::BIGINT AS n, sum(length(c.text))::BIGINT AS chars FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn BETWEEN a AND b GROUP BY r.conv_id, a, b""")
def range_join_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    r = s.groupBy("video_id").agg(F.min("seg_idx").alias("start_idx"), F.floor(F.max("seg_idx") / 2).cast("int").alias("end_idx"))
    return intervals.covered_segments(r, s, ["video_id", "start_idx", "end_idx"]).groupBy("video_id", "start_idx", "end_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH g AS ({SEGMENTS}), r AS (SELECT conv_id, min(turn) AS a, max(turn) // 2 AS b FROM conversations GROUP BY conv_id)
SELECT r.conv_id AS video_id, a::INT AS start_idx, b::INT AS end_idx, x.s::DOUBLE AS start_s, (y.s + y.n / 10.0)::DOUBLE AS end_s FROM r LEFT JOIN g x ON x.conv_id = r.conv_id AND x.turn = a LEFT JOIN g y ON y.conv_id = r.conv_id AND y.turn = b WHERE y.s + y.n / 10.0 > x.s""")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    r = s.groupBy("video_id").agg(F.min("seg_idx").alias("start_idx"), F.floor(F.max("seg_idx") / 2).cast("int").alias("end_idx"))
    return intervals.range_times(r, s).select("video_id", "start_idx", "end_idx", "start_s", "end_s")


@query("""WITH e AS (SELECT user_id, event_type AS k, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 600 AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e),
i AS (SELECT *, sum((far IS NULL OR s > far + 2.0)::INT) OVER (PARTITION BY user_id, k ORDER BY s, e) AS island FROM m)
SELECT user_id AS video_id, 'T' || row_number() OVER (PARTITION BY user_id ORDER BY k, min(s)) AS topic_id, k AS title, min(s) AS start_s, max(e) AS end_s FROM i GROUP BY user_id, k, island""")
def consolidate_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lists of any length, as in the SQL; consolidate_topics_shrunk shrinks them
    return intervals.consolidate_topics(event_topics(spark, sf_dir), most=1_000_000).select("video_id", "topic_id", "title", "start_s", "end_s")


#: While a list has over twelve topics, its shortest is absorbed by the one before it, or, if it is the first, by the next.
SHRUNK = SQL["consolidate_topics"].replace("WITH e AS", "WITH RECURSIVE e AS").replace("SELECT user_id AS video_id, 'T' || row_number() OVER (PARTITION BY user_id ORDER BY k, min(s)) AS topic_id, k AS title, min(s) AS start_s, max(e) AS end_s FROM i GROUP BY user_id, k, island", """, g AS (SELECT user_id, k, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, k, island),
l AS (SELECT user_id, list({'k': k, 's': s, 'e': e} ORDER BY k, s) AS t FROM g GROUP BY user_id),
r AS (SELECT user_id, t FROM l UNION ALL SELECT user_id, list_concat(t[:least(k, o) - 1], [CASE WHEN k = 1 THEN {'k': t[2].k, 's': least(t[1].s, t[2].s), 'e': t[2].e} ELSE {'k': t[o].k, 's': t[o].s, 'e': greatest(t[k].e, t[o].e)} END], t[greatest(k, o) + 1:])
 FROM (SELECT *, CASE WHEN k = 1 THEN 2 ELSE k - 1 END AS o FROM (SELECT user_id, t, list_position(list_transform(t, lambda x: x.e - x.s), list_min(list_transform(t, lambda x: x.e - x.s))) AS k FROM r WHERE len(t) > 12))),
f AS (SELECT user_id, t FROM r WHERE len(t) <= 12)
SELECT user_id AS video_id, 'T' || p::VARCHAR AS topic_id, t[p].k AS title, t[p].s AS start_s, t[p].e AS end_s FROM (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM f)""")


@query(SHRUNK)
def consolidate_topics_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.consolidate_topics(event_topics(spark, sf_dir)).select("video_id", "topic_id", "title", "start_s", "end_s")


def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("title"), F.lit("").alias("description"), F.array(F.lit("q")).alias("evidence_quotes"), s.alias("start_s"), (s + F.col("value") * 600).alias("end_s"))


#: Least total cost over all sections whose ends are multiples of 5 (the last one free), by dynamic programming over lists.
CHANGES = """WITH RECURSIVE x AS (SELECT label::VARCHAR || '/' || (vec_id // 500)::VARCHAR AS video_id, row_number() OVER (PARTITION BY label, vec_id // 500 ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT video_id, count(*) AS n FROM x GROUP BY 1),
d AS (SELECT a.video_id, a.i, b.i AS j, list_sum(list_transform(range(1, len(a.e) + 1), lambda k: (a.e[k] - b.e[k]) * (a.e[k] - b.e[k]))) AS d FROM x a JOIN x b ON a.video_id = b.video_id),
m AS (SELECT video_id, coalesce(median(d), 0) AS m FROM d WHERE i < j GROUP BY 1), k AS (SELECT d.video_id, i, j, CASE WHEN i = j THEN 1 ELSE exp(-least(greatest(CASE WHEN m > 0 THEN d / m ELSE d END, 0.01), 100)) END AS k FROM d LEFT JOIN m USING (video_id)),
p AS (SELECT video_id, i, j, sum(r) OVER (PARTITION BY video_id, j ORDER BY i) AS p FROM (SELECT video_id, i, j, sum(k) OVER (PARTITION BY video_id, i ORDER BY j) AS r FROM k)),
g AS (SELECT video_id, n, e, row_number() OVER (PARTITION BY video_id ORDER BY e) AS q FROM (SELECT video_id, n, unnest(list_append(list_filter(range(0, n, 5), lambda e: e >= 6), n)) AS e FROM n WHERE n >= 12)),
s AS (SELECT video_id, 0 AS q, 0 AS e FROM n WHERE n >= 12 UNION ALL SELECT video_id, q, e FROM g),
c AS (SELECT g.video_id, g.q, list(CASE WHEN g.e - s.e >= 6 THEN (g.e - s.e) - (a.p - 2 * coalesce(b.p, 0) + coalesce(c.p, 0)) / (g.e - s.e) + 15 ELSE 1e18 END ORDER BY s.q) AS cost, any_value(g.e) AS e
 FROM g JOIN s ON s.video_id = g.video_id AND s.q < g.q JOIN p a ON a.video_id = g.video_id AND a.i = g.e - 1 AND a.j = g.e - 1 LEFT JOIN p b ON b.video_id = g.video_id AND b.i = s.e - 1 AND b.j = g.e - 1 LEFT JOIN p c ON c.video_id = g.video_id AND c.i = s.e - 1 AND c.j = s.e - 1 GROUP BY 1, 2),
w AS (SELECT video_id, 0::BIGINT AS q, [0.0::DOUBLE] AS best, [[0::BIGINT]] AS way FROM s WHERE q = 0
 UNION ALL SELECT video_id, q + 1, list_append(best, list_min(t)), list_append(way, list_append(way[list_position(t, list_min(t))], e)) FROM (SELECT w.video_id, w.q, best, way, c.e, list_transform(range(1, len(best) + 1), lambda z: best[z] + c.cost[z]) AS t FROM w JOIN c ON c.video_id = w.video_id AND c.q = w.q + 1)),
f AS (SELECT video_id, arg_max(way[len(way)], q) AS ends FROM w GROUP BY 1 UNION ALL SELECT video_id, [0, n] FROM n WHERE n < 12),
o AS (SELECT video_id, unnest(range(1, len(ends))) AS z, ends FROM f)
SELECT video_id, 's' || lpad((z - 1)::VARCHAR, 3, '0') || '_' || ends[z]::VARCHAR || '_' || ends[z + 1]::VARCHAR AS section_id, ends[z]::INT AS start, ends[z + 1]::INT AS "end", (ends[z + 1] - ends[z])::INT AS n_frames FROM o"""


@query(CHANGES)
def sections_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 500).cast("string")).alias("video_id"), F.format_string("frame_%06d.jpg", "vec_id").alias("frame"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("caption"), "embedding")
    return sections.sections(e).select("video_id", "section_id", "start", "end", F.size("frames").alias("n_frames"))


@query(CHANGES.replace("+ 15 ELSE", "+ 0.25 ELSE"))
def sections_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a small penalty, so that videos part into several sections."""
    e = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 500).cast("string")).alias("video_id"), F.format_string("frame_%06d.jpg", "vec_id").alias("frame"), F.lit("c").alias("caption"), "embedding")
    return sections.sections(e, penalty=0.25).select("video_id", "section_id", "start", "end", F.size("frames").alias("n_frames"))
