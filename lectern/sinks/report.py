"""Reports as ordered blocks (``video_id``, ``seq``, ``kind``, ``level``, ``text``), and documents from them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import coverage as C
from ..operators.groups import representatives


def blocks(*parts: tuple[int, DataFrame]) -> DataFrame:
    """Unite parts (``video_id``, ``pos``, ``kind``, ``level``, ``text``) and number the blocks of each video."""
    out = None
    for k, df in parts:
        own = df.select("video_id", F.lit(k).alias("part"), F.col("pos").cast("string").alias("pos"), "kind", F.col("level").cast("int").alias("level"), "text")
        out = own if out is None else out.unionByName(own)
    seq = F.row_number().over(Window.partitionBy("video_id").orderBy("part", "pos")) - 1
    return out.select("video_id", seq.alias("seq"), "kind", "level", "text")


def block(df: DataFrame, pos: Column, kind: str, level: int, text: Column) -> DataFrame:
    return df.select("video_id", pos.alias("pos"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("text"))


def key(*columns: Column) -> Column:
    """A text that sorts like the numbers."""
    return F.concat_ws("/", *[F.format_string("%09d", c.cast("long")) for c in columns])


def correlation_report(units: DataFrame, candidates: DataFrame, records: DataFrame, available: DataFrame | None = None, frames: DataFrame | None = None, min_score: int = C.MIN_SCORE, k: int = C.TOP_K, thumbs: int = 3) -> DataFrame:
    """Totals, coverage by comment, strongest and weakest units, kept comments by unit, with thumbnails."""
    covered = C.coverage(candidates.join(units.select("video_id", "unit_id"), ["video_id", "unit_id"], "left_semi"), min_score)
    total = C.total_pairs(records).join(C.coverage_summary(covered, available), "video_id", "left")
    head = block(total, F.lit(0), "heading", 1, F.concat(F.lit("Correlation report: "), "video_id"))
    percent = F.when(F.col("percent").isNotNull(), F.concat(F.lit(" ("), X.fixed(F.round("percent", 1), 1), F.lit("%)"))).otherwise(F.lit(""))
    sums = block(total, F.lit(0), "paragraph", 0, F.concat(F.lit("Pairs checked: "), "total_pairs", F.lit("; comments with a match: "), F.coalesce("n_correlated", F.lit(0)), percent))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*C.coverage_order(), "url"))
    lines = block(covered.withColumn("n", n), key(F.col("n")), "bullet", 0, F.concat(F.col("n_units").cast("string"), F.lit(" units, best "), F.col("max_score").cast("string"), F.lit(": "), "comment"))
    ranked = C.top_units(C.unit_ranking(units, candidates, min_score))
    tops = block(ranked, F.concat(F.when(F.col("side") == "top", "a").otherwise("b"), key(F.col("rank"))), "bullet", 0, F.concat("side", F.lit(" "), F.col("rank").cast("string"), F.lit(": "), "title", F.lit(" "), X.fixed(F.round("avg_score", 2), 2), F.lit(" over "), F.col("contributions").cast("string")))
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    numbered = units.withColumn("n", order)
    names = block(numbered, key(F.col("n")), "heading", 2, F.col("title"))
    kept = C.kept_comments(candidates, min_score, k).join(numbered.select("video_id", "unit_id", "n"), ["video_id", "unit_id"])
    best = block(kept, key(F.col("n"), F.col("rank")), "bullet", 0, F.concat(F.lit("["), F.col("score").cast("int").cast("string"), F.lit("] "), "comment", F.lit(" - "), "reason"))
    parts = [(0, head), (1, sums), (2, lines), (3, tops), (4, names.unionByName(best))]
    if frames is not None:
        own = frames.groupBy("video_id").agg(F.sort_array(F.collect_list("frame")).alias("f"))
        parts.append((5, block(own, F.lit(0), "thumbnails", 0, F.array_join(representatives(F.col("f"), thumbs), ","))))
    return blocks(*parts)


def metrics_table(metrics: DataFrame) -> DataFrame:
    """A row of cells for each video; null is a dash."""
    cell = lambda c, d: X.fixed(F.col(c), d, "—")
    counts = [c for c in ("frames", "transcript_words", "topics", "comments") if c in metrics.columns]
    text = F.concat_ws("\t", "video_id", *[F.col(c).cast("string") for c in counts], cell("corr_avg", 3), cell("corr_median", 2))
    return blocks((0, block(metrics, F.lit(0), "row", 0, text)))


def topics_document(topics: DataFrame, texts: DataFrame, stamped: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Topics with their times, then the transcript by paragraphs, or the timestamped lines where there is none.

    With ``documents`` (``sources.files.topic_documents``) a video whose topics file has no topics is there as well, be it by its heading alone.
    """
    from ..functions.times import hms

    ids = topics.select("video_id").unionByName(texts.select(F.col("file").alias("video_id"))).unionByName(stamped.select("video_id"))
    ids = (ids if documents is None else ids.unionByName(documents.select("video_id"))).distinct()
    title = block(ids.join(texts.select(F.col("file").alias("video_id"), "title", "url"), "video_id", "left"), F.lit(0), "heading", 1, F.concat_ws(" ", F.coalesce("title", "video_id"), "url"))
    span = F.when(F.col("start_s").isNotNull(), F.concat(F.lit(" ("), hms(F.col("start_s")), F.lit(" - "), hms(F.col("end_s")), F.lit(")"))).otherwise(F.lit(""))
    heads = block(topics, key(F.col("pos"), F.lit(0)), "heading", 2, F.concat("topic_id", F.lit(". "), "title", span))
    body = block(topics.where("description <> ''"), key(F.col("pos"), F.lit(1)), "paragraph", 0, F.col("description"))
    paras = texts.select(F.col("file").alias("video_id"), F.posexplode(X.paragraphs(F.col("body"))).alias("p", "text"))
    words = block(paras, key(F.col("p")), "paragraph", 0, F.col("text"))
    rest = stamped.join(texts.select(F.col("file").alias("video_id")), "video_id", "left_anti").select("video_id", F.posexplode(X.lines(F.col("text"))).alias("p", "text"))
    return blocks((0, title), (1, heads.unionByName(body)), (2, words), (3, block(rest, key(F.col("p")), "paragraph", 0, F.col("text"))))


def opinion_document(counts: DataFrame, reasons: DataFrame) -> DataFrame:
    """Counts and reasons, most common first, by video link."""
    c = counts.withColumnRenamed("link", "video_id")
    head = block(c, F.lit(0), "heading", 1, F.col("video_id"))
    sums = block(c, F.lit(0), "paragraph", 0, F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in counts.columns if n != "link"]))
    r = reasons.withColumnRenamed("link", "video_id")
    return blocks((0, head), (1, sums), (2, block(r, key(F.col("rank")), "bullet", 0, F.concat("reason", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))))


def combined_document(reports: DataFrame) -> DataFrame:
    """All videos' blocks in one order, a page break between them."""
    last = reports.groupBy("video_id").agg(F.max("seq").alias("m")).select("video_id", (F.col("m") + 1).alias("seq"), F.lit("page_break").alias("kind"), F.lit(0).alias("level"), F.lit("").alias("text"))
    return reports.unionByName(last).orderBy("video_id", "seq")


def docx(rows: list) -> bytes:
    """A DOCX of one report's blocks."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def paragraph(r) -> str:
        if r["kind"] == "page_break":
            return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
        style = {"heading": f"Heading{r['level']}", "bullet": "ListBullet"}.get(r["kind"])
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{props}<w:r><w:t xml:space="preserve">{escape(r["text"] or "")}</w:t></w:r></w:p>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {w}><w:body>{"".join(paragraph(r) for r in rows)}</w:body></w:document>')
    return out.getvalue()


def documents(reports: DataFrame) -> DataFrame:
    """``video_id`` and ``content``: a DOCX for each video, made where its blocks are."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        return pd.DataFrame({"video_id": [g["video_id"].iloc[0]], "content": [docx(g.to_dict("records"))]})

    return reports.groupBy("video_id").applyInPandas(run, "video_id string, content binary")
