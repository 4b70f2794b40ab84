"""Models in the plans, stood for by rules that SQL can repeat: scoring, extraction with retries, the cascade, opinions."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as X
from ..models import scorers, tasks
from ..models.ledger import Ledger, fingerprint, said
from ..operators import coverage as cov
from ..operators import intervals, opinions
from . import report_queries as R
from .registry import query, table


def number(prompt: str) -> int:
    return int(re.findall(r"\d+", prompt)[-1])


class Judge:
    """Scores a pair by the number that ends its prompt; some replies are prose, some fail."""

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        n = number(prompt)
        if n % 5 == 4:
            raise RuntimeError("gone")
        if n % 5 == 3:
            return f"Yes, I would say {n % 100}."
        return "So: " + json.dumps({"correlated": ("yes", "no")[n % 2], "score": n % 150, "reason": f" because {n} "}) + " done"


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN false WHEN 3 THEN true ELSE event_id % 2 = 0 END AS correlated, CASE event_id % 5 WHEN 4 THEN 0 WHEN 3 THEN event_id % 100 ELSE least(event_id % 150, 100) END::INT AS score,
 CASE event_id % 5 WHEN 4 THEN '[Error: gone]' WHEN 3 THEN 'Yes, I would say ' || (event_id % 100)::VARCHAR || '.' ELSE 'because ' || event_id::VARCHAR END AS reason FROM events""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies to pairs: JSON in prose, prose alone, failures."""
    pairs = table(spark, sf_dir, "events").select("event_id")
    return scorers.score_by_model(pairs, Judge(), F.concat(F.lit("Rate pair "), F.col("event_id").cast("string")), tries=2)


class Streaming:
    """A reply in parts; the third part of some is an error."""

    def __call__(self, prompt: str):
        n = number(prompt)
        yield {"content": "part "}
        yield {"content": str(n)}
        if n % 3 == 0:
            yield {"error": "cut"}
        yield {"content": "!"}


@query("SELECT page_id, 'part ' || page_id::VARCHAR || CASE WHEN page_id % 3 = 0 THEN '[Error: cut]' ELSE '!' END AS reply, page_id % 3 = 0 AND false AS failed FROM pages")
def streamed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of replies joined; an error ends a reply, which is no error mark as it does not begin with one."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("_p"))
    return scorers.complete(p, tasks.Streamed(Streaming()), "_p", "reply").drop("_p").withColumn("failed", X.is_error(F.col("reply")))


@query("SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 2 AS failed FROM documents")
def error_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks before the document's text, behind it, and none: only a text that begins with one is a failure."""
    text = F.coalesce("text", F.lit(""))
    shape = F.element_at(F.array(F.concat(F.lit("[Error: "), text, F.lit("]")), F.concat(text, F.lit(" [Error: x]")), F.lit("[No content received]"), text), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.is_error(shape).alias("failed"))


# --- topics


class Outliner:
    """Topics of the chunk whose number ends the prompt's first line: at once, fenced, at the second or third try, or never."""

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        n, kind = number(prompt.split("\n")[0]), number(prompt.split("\n")[0]) % 6
        item = {"title": f" Topic {n} ", "description": f"About {n}", "time_range": f"00:{n % 60:02d} – 01:{n % 60:02d}", "quotes": [f"q{k}" for k in range(n % 6)]}
        good = json.dumps([item, {"title": "no times", "description": "x"}, {"title": "", "description": "x", "start": 1, "end": 2}, {"title": "Turned", "description": "x", "start": 9, "end": 2}, 5], ensure_ascii=False)
        if kind == 1:
            return f"```json\n{good}\n```"
        if kind == 2 and scorers.HINT not in prompt:
            return "Let me think."
        if kind == 3 and scorers.STRICT not in prompt:
            return "[{]"
        if kind == 4:
            return "I cannot."
        if kind == 5:
            return f"{json.dumps(item, ensure_ascii=False)} and {json.dumps(item, ensure_ascii=False)}"
        return good


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 1 END::INT AS attempts, CASE event_id % 6 WHEN 4 THEN 'no JSON array' END AS error, t AS pos,
 CASE WHEN t IS NOT NULL THEN 'Topic ' || event_id::VARCHAR END AS title, CASE WHEN t IS NOT NULL THEN array_to_string(list_transform(range(least(event_id % 6, 3)), lambda k: 'q' || k::VARCHAR), ',') END AS quotes, CASE WHEN t IS NOT NULL THEN (event_id % 60)::DOUBLE + event_id END AS start_s, CASE WHEN t IS NOT NULL THEN (event_id % 60 + 60)::DOUBLE + event_id END AS end_s
 FROM events LEFT JOIN (SELECT 0 AS t, 6 AS lim UNION ALL SELECT 1, 1) x ON event_id % 6 <> 4 AND (t = 0 OR event_id % 6 = 5)""")
def extraction_with_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics from replies of all kinds, with a hint from the second try and a strict ending on the last; times made absolute."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("chunk "), F.col("event_id").cast("string"), F.lit("\ntext")).alias("prompt"))
    got = scorers.extract_with_retries(e, Outliner(), "prompt")
    t = got.select("event_id", F.size("extracted.attempts").alias("attempts"), "extracted.error", F.col("event_id").cast("double").alias("chunk_start"), F.posexplode_outer("extracted.parsed").alias("pos", "t"))
    t = t.select("event_id", "attempts", "error", "pos", "chunk_start", "t.title", F.array_join("t.evidence_quotes", ",").alias("quotes"), "t.start_s", "t.end_s")
    return intervals.shift_to_absolute(t).drop("chunk_start")


class Stages:
    """Answers a stage only for the ids that it is meant for."""

    def __init__(self, rest: tuple[int, ...]):
        self.rest = rest

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        n = number(prompt.split("\n")[0])
        if n % 5 not in self.rest:
            return "[]" if n % 2 else "nothing"
        return json.dumps([{"title": f"T{n}", "description": "d", "start_s": 1, "end_s": 2, "time_range": "1-2", "coverage": [{"start_idx": 0, "end_idx": n}, {"end_idx": 1}]}])


@query("SELECT video_id::VARCHAR AS video_id, CASE WHEN video_id % 5 = 0 THEN 'whole_simple' WHEN video_id % 5 IN (1, 2) THEN 'whole_timestamped' ELSE 'chunked' END AS mode, 'T' || video_id::VARCHAR AS title, CASE WHEN video_id % 5 = 0 THEN video_id END::INT AS until FROM (SELECT DISTINCT page_id AS video_id FROM pages) WHERE video_id % 5 < 4")
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways of extraction; each sees what the ones before left without topics."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("video_id")).distinct()

    def ask(mode: str, rest: tuple[int, ...]):
        def stage(left: DataFrame) -> DataFrame:
            asked = left.select("video_id", F.concat(F.lit("video "), "video_id", F.lit("\n")).alias("prompt"))
            return scorers.extract_with_retries(asked, Stages(rest), "prompt", mode=mode).select("video_id", F.col("extracted.parsed").alias("topics"))

        return stage

    got = scorers.cascade(p, ("whole_simple", ask("simple", (0,))), ("whole_timestamped", ask("whole", (0, 1, 2))), ("chunked", ask("chunk", (2, 3))))
    first = F.element_at("topics", 1)
    return got.select("video_id", "mode", first["title"].alias("title"), F.element_at(first["coverage"], 1)["end_idx"].alias("until"))


@query("""SELECT event_id, kind, title, "start", "end" FROM (SELECT event_id, 'outline' AS kind, 'T' || event_id::VARCHAR AS title, 3.5::DOUBLE AS "start", 7.0::DOUBLE AS "end" FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'covered', 'T' || event_id::VARCHAR, NULL, NULL FROM events WHERE event_id % 4 < 3)""")
def outline_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines by times need both, in order, as numbers or texts of numbers; those by lines need only a title and a description."""
    times = F.element_at(F.array(*[F.lit(x) for x in ('"start_s": "3.5", "end_s": 7', '"start_s": 7, "end_s": 3.5', '"start_s": "soon", "end_s": 9', '"start_s": 1')]), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.when(F.col("event_id") % 4 == 3, "").otherwise("about")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('[{"title": "T'), F.col("event_id").cast("string"), F.lit('", "description": "'), body, F.lit('", '), times, F.lit("}]")).alias("reply"))
    out = None
    for kind, mode in (("outline", "whole"), ("covered", "simple")):
        asked = scorers.extract_with_retries(e, Echo(), "reply", 1, mode)
        own = asked.select("event_id", F.lit(kind).alias("kind"), F.explode("extracted.parsed").alias("t")).select("event_id", "kind", "t.title", F.col("t.start_s").alias("start"), F.col("t.end_s").alias("end"))
        out = own if out is None else out.unionByName(own)
    return out


class Echo:
    """Says what it was asked, without the endings of later tries."""

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        return prompt.replace(scorers.STRICT, "").replace(scorers.HINT, "")


@query("SELECT page_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'Page ' || page_id::VARCHAR ELSE 'Bold' END AS title, CASE pos WHEN 0 THEN 'one two' ELSE 'three' END AS description FROM pages, (SELECT unnest([0, 1]) AS pos)")
def markdown_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics from a Markdown outline: headings and bold lines open one, bullets and lines join its description."""
    text = F.concat(F.lit("before\n\n## Page "), F.col("page_id").cast("string"), F.lit("\n* one\n  two \n\n**Bold**\n- three\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(replies.markdown_outline(text)).alias("pos", "t")).select("page_id", "pos", "t.title", "t.description")


@query("""WITH b AS (SELECT item_id, regexp_extract(text, '^[^ ]+', 0) AS head, trim(text, ' ' || chr(10)) AS body FROM benchmark)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN head || chr(10) || body WHEN 1 THEN head ELSE body END AS text FROM b""")
def topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of an item as the title, its text as the description: on two lines, or the one that there is."""
    title = F.when(F.col("item_id") % 3 != 2, F.concat(F.lit(" "), F.regexp_extract("text", "^[^ ]+", 0), F.lit(" "))).otherwise("")
    return table(spark, sf_dir, "benchmark").select("item_id", X.topic_text(title, F.when(F.col("item_id") % 3 != 1, F.concat(F.lit(" "), "text", F.lit(" ")))).alias("text"))


# --- the ledger


class Reluctant:
    """Answers by the length of a text: at once, when hinted at, when told strictly, or never."""

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        strict, hinted = prompt.endswith(scorers.STRICT), prompt.endswith(scorers.HINT)
        n = len(prompt.removesuffix(scorers.STRICT).removesuffix(scorers.HINT))
        if n % 4 == 0:
            raise RuntimeError("no")
        return f"fine {n}" if n % 4 == 3 or strict or (hinted and n % 4 == 1) else "what?"


def ask_reluctantly(ledger: Ledger, docs: DataFrame) -> DataFrame:
    return ledger.ask(docs, Reluctant(), "text", label="reluctant", tries=3, phrase=scorers.phrase, accept=lambda r: r.startswith("fine"))


TRIES = "CASE length(coalesce(text, '')) % 4 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END"


@query(f"""WITH p AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), t AS (SELECT text, {TRIES} AS tries, unnest(range({TRIES})) AS k FROM p)
SELECT k::INT AS "try", count(*)::BIGINT AS calls, count(DISTINCT text)::BIGINT AS prompts, count_if(length(text) % 4 > 0 AND k = tries - 1)::BIGINT AS accepted, count_if(length(text) % 4 = 0)::BIGINT AS errors FROM t GROUP BY k""")
def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by try: one for each different text, however many documents hold it and however often the result is used."""
    ledger = Ledger(spark)
    asked = ask_reluctantly(ledger, table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked.count(), asked.where("size(calls) = 3").count()
    calls = ledger.calls().groupBy("try").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("key").alias("prompts"), F.count_if("accepted").alias("accepted"), F.count("error").alias("errors"))
    return calls.select("try", "calls", "prompts", "accepted", "errors")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), e AS (SELECT DISTINCT text FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN text IN (SELECT text FROM e) THEN 1 ELSE 2 END AS run, {TRIES} AS tries, CASE length(text) % 4 WHEN 0 THEN '[Error: no]' ELSE 'fine ' || length(text)::VARCHAR END AS reply FROM d""")
def ledger_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the even ids, in commits of 100 calls, and one over all, which asks only what the first did not."""
    first = Ledger(spark, commit_calls=100)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ask_reluctantly(first, docs.where("doc_id % 2 = 0"))
    second = Ledger(spark, first.path)
    asked = ask_reluctantly(second, docs).withColumn("key", fingerprint("reluctant\n3", F.col("text")))
    runs = second.calls().groupBy("key").agg(F.when(F.max("run") == F.min("run"), F.when(F.max("run") == first.run, 1).otherwise(2)).alias("run"))
    return asked.join(runs, "key").select("doc_id", "run", F.size("calls").alias("tries"), said(F.col("calls")).alias("reply"))


# --- captions, opinions, coverage


class Merger:
    def complete(self, prompt: str, image: bytes | None = None) -> str:
        n = number(prompt)
        return f"I looked.\nFinal Caption: both {n}\nof them" if n % 2 else "no idea"


@query("SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'both ' || page_id::VARCHAR || chr(10) || 'of them' ELSE url END AS caption FROM pages")
def merged_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One caption of two, a page's address and its text: what a reply marks as final, else the first."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("caption_a"), F.col("html").alias("caption_b"))
    asked = p.select("page_id", "caption_a", F.concat("caption_b", F.lit(" of "), F.col("page_id").cast("string")).alias("_p"))  # the text goes to Python once
    return tasks.merge_captions(asked, Merger(), F.col("_p")).select("page_id", "caption")


class Reader:
    """Answers the opinion questions from words of the paragraph."""

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        question, paragraph = prompt.split("\n\n", 1)
        if "like or dislike" in question:
            return "I like it" if "good" in paragraph else "neutral"
        if question.startswith("Name the main reason"):
            return " Clear  pace"
        if question.startswith("Name the way"):
            return "reading"
        return ("Yes - by hand" if "hand" in paragraph else "no") if "body" in question else ("They reasoned" if "because" in paragraph else "no")


@query("""SELECT user_id AS link, count(*)::BIGINT AS opinions, count_if(event_id % 2 = 0)::BIGINT AS "like", count_if(event_id % 6 = 0)::BIGINT AS embodied_like, count_if(event_id % 2 = 0 AND event_id % 3 > 0)::BIGINT AS others FROM events GROUP BY user_id""")
def opinion_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five questions on each opinion, a sixth only where it is liked and not embodied."""
    text = F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, "good"), F.when(F.col("event_id") % 3 == 0, "by hand"), F.when(F.col("event_id") % 5 == 0, "because"), F.lit("."))
    asked = tasks.ask_opinions(table(spark, sf_dir, "events").select(F.col("user_id").alias("link"), F.col("event_id").alias("seq"), text.alias("paragraph")), Reader())
    counts = opinions.label_counts(opinions.label(asked)).select("link", "opinions", "like", "embodied_like")
    others = asked.groupBy(F.col("link").alias("_l")).agg(F.count("other_reply").alias("others"))
    return counts.join(others, F.col("link").eqNullSafe(F.col("_l"))).drop("_l")


@query(R.LAST + ", g AS (SELECT video_id, url, comment, count_if(ok) AS n, coalesce(max(score) FILTER (ok), 0) AS best FROM p GROUP BY 1, 2, 3) SELECT video_id, comment, url, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, best DESC, comment DESC, url)::INT AS place FROM g")
def coverage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments by how many units they meet, then by score, then by text from behind."""
    from pyspark.sql import Window

    c = cov.coverage(R.candidates(spark, sf_dir))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy(*cov.coverage_order(), "url"))).select("video_id", "comment", "url", "place")


@query(f"""SELECT item_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS square, list_count(list_filter(e, lambda x: x > 0))::BIGINT AS positive, round(e[1], 6) AS first, round(e[64], 6) AS last FROM (SELECT item_id, {R.unit_sql("v")} AS e FROM (SELECT item_id, {R.vector_sql("text")} AS v FROM benchmark))""")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of texts, told by their length, signs and ends."""
    e = scorers.embed(table(spark, sf_dir, "benchmark"), "text").withColumn("e", F.col("embedding").cast("array<double>"))
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("item_id", F.round(square, 6).alias("square"), F.size(F.filter("e", lambda x: x > 0)).cast("long").alias("positive"), F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(63)), 6).alias("last"))
