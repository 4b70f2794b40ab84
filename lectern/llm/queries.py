"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, chat, classifier, decontaminate, jaccard_join, lexical, licences, pii, quality_rules, secrets, simhash, spelling, suffix_dedup
from .shared import materialise
from .textkit import map_batches

#: The key of the test data; a deployment sets its own secret as ``lectern.pii.key`` in the session.
PII_KEY = b"lectern: key of the test data"


def pii_key(spark: SparkSession) -> bytes:
    own = spark.conf.get("lectern.pii.key", None)
    if not own:
        warnings.warn("lectern.pii.key is not set: pseudonyms are made by the published key of the test data and can be undone by anyone", stacklevel=2)
    return own.encode() if own else PII_KEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- 1


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    schema = T.StructType([T.StructField(n, T.LongType() if n[-3:] != "256" else T.StringType()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites")])

    def digest(batch: pa.RecordBatch) -> dict:
        out = {n: [] for n in schema.fieldNames()[1:]}
        for formatted, spans, rewrites in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), batch.column("rewrites").to_pylist()):
            turns = chat.read_back(formatted)
            loss = "".join(chat.unescape(formatted[a:b]) for a, b in spans)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()))
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(sha(loss.encode()))
            out["formatted_chars"].append(len(formatted))
            out["n_rewrites"].append(len(rewrites))
        return {"conv_id": batch.column("conv_id")} | out

    return map_batches(chat.format_conversations(rows), digest, schema)


SQL1 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g')) AS n,
  length(role) + length(regexp_replace(role, '[^\\<>\[\]]', '', 'g')) AS m FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 4 ELSE n + m + 9 END)::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites
FROM e GROUP BY conv_id"""

# --- 2


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\x01-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL2 = rf"""
WITH b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM b),
q AS (SELECT win, least(n, 10) AS m, item_id FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q) WHERE len(w) >= m)),
h AS (SELECT r, i, g.m, item_id FROM g JOIN q ON g.win = q.win AND g.m = q.m),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS k, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(k, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""

# --- 3


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Pairs of equal five-word windows of a text lie on diagonals; runs along them are repeats, and a word's longest repeat is that of the longest run from it.
SQL3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT a.r, a.i, b.i - a.i AS gap FROM g a JOIN g b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i),
q AS (SELECT r, i, gap, max(i) OVER (PARTITION BY r, gap, run) - i + 5 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, gap ORDER BY i) AS run FROM p)),
l AS (SELECT r, i, max(n) AS n FROM (SELECT r, i, n FROM q UNION ALL SELECT r, i + gap, n FROM q) GROUP BY r, i),
m AS (SELECT x.r, x.i, length(word) AS c, coalesce(l.n, 0) AS n, coalesce(lag(l.n) OVER (PARTITION BY x.r ORDER BY x.i), 0) AS before FROM x LEFT JOIN l ON l.r = x.r AND l.i = x.i),
u AS (SELECT *, max(CASE WHEN n > 0 AND before <= n THEN i + n END) OVER o > i AS covered, max(CASE WHEN n > 0 THEN i + 5 END) OVER o > i AS again FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, sum(c) AS word_chars, count_if(again) AS n_repeat_words, count_if(n > 0 AND before <= n) AS n_maximal_repeats, count_if(covered) AS repeat_covered_words, coalesce(sum(c) FILTER (covered), 0) AS repeat_covered_chars, coalesce(max(n) FILTER (n > 0 AND before <= n), 0) AS longest FROM u GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT s) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
z AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 coalesce(n_maximal_repeats, 0)::BIGINT AS n_maximal_repeats, coalesce(repeat_covered_words, 0)::BIGINT AS repeat_covered_words, coalesce(repeat_covered_chars, 0)::BIGINT AS repeat_covered_chars, coalesce(longest, 0)::BIGINT AS longest_repeat_words FROM d LEFT JOIN a USING (r) LEFT JOIN ln USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 5 * repeat_covered_chars <= word_chars AND longest_repeat_words <= 100 AS kept FROM z"""

# --- 4


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("digest", "group")


SQL4 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, count(*) AS n FROM g WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, len(s) AS k, unnest(s) AS gram FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM x a JOIN x b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.k, b.k HAVING count(*) >= 0.8 * (a.k + b.k - count(*)) - 1e-6),
q AS (SELECT rep AS a, rep AS b FROM c UNION SELECT q.a, p.y FROM q JOIN p ON q.b = p.x),
m AS (SELECT a AS rep, min(b) AS class_id FROM q GROUP BY a),
l AS (SELECT x AS rep, count(*) AS n_links FROM p GROUP BY x)
SELECT doc_id, coalesce(c.rep, doc_id) AS copy_id, coalesce(class_id, doc_id) AS class_id, coalesce(c.n, 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM g LEFT JOIN c ON g.s = c.s LEFT JOIN m ON m.rep = c.rep LEFT JOIN l ON l.rep = c.rep"""

# --- 5


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


# --- 6


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "documents"), sf_dir).select("doc_id", "host", "path", "logit_doc", "host_rate", "path_rate", "p_good", "kept")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str, *carry: str) -> DataFrame:
    """``docs`` scored by models of the labels; the source is the host, the source and language its path."""
    models = classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    sited = docs.withColumn("host", F.col("source")).withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
    scored = classifier.score(sited.select("doc_id", "text", "host", "path", *carry), models)
    scored = materialise(scored if carry else scored.drop("text"), "scored")  # scored once, used twice
    return classifier.classify(scored, classifier.site_posteriors(scored.select("host", "path", "logit_doc")))


# --- 7


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *tokenizer(), reduce=bpe.digests, fields=bpe.DIGESTS).drop("text")


# --- 8


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = ("assign", "access", "hex")
    schema = T.StructType([found.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in base], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def digest(batch: pa.RecordBatch) -> dict:
        rows = batch.column("secrets").to_pylist()
        line = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
        return {"doc_id": batch.column("doc_id"), "base_sha256": [sha(line([s for s in r if s["kind"] in base]).encode()) for r in rows], "spans": [line(r) for r in rows]} | {f"n_{k}": [sum(s["kind"] == k for s in r) for r in rows] for k in base}

    return map_batches(found, digest, schema)


def sql8() -> str:
    """The rules are put in as values; a match begins where the pieces and matches before it end."""
    value = r"[A-Za-z0-9+/_.=-]+"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.kind)}, {k}, {quoted(r.pattern)}, {r.least}, {str(r.tail).lower()}, {quoted(r.pattern.removesuffix(value) + '(' + value + ')')})" for k, r in enumerate(secrets.RULES))
    line = "string_agg(kind || ':' || a::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY a, k)"
    return rf"""
WITH k(kind, k, pat, least, tail, parted) AS (VALUES {rules}), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, k.*, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS p FROM d, k),
s AS (SELECT r, kind, k, least, tail, parted, m[i] AS m, list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT r, kind, k, a::BIGINT AS a, (a + length(m))::BIGINT AS e FROM s WHERE length(CASE WHEN tail THEN regexp_extract(m, parted, 2) ELSE m END) >= least),
g AS (SELECT r, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, {line} FILTER (k < 3) AS base, {line} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


# --- 9


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 200 bytes by their digests, in hexadecimal text, cut from blocks so that none is far into a text.
SQL9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2) AS n FROM documents),
b AS (SELECT r, n, o, substring(h, 2 * o + 1, 2398) AS s FROM (SELECT r, n, h, unnest(range(0, n - 199, 1000)) AS o FROM d WHERE n >= 200)),
w AS (SELECT r, o + j AS p, md5(substring(s, 2 * j + 1, 400)) AS k FROM (SELECT r, o, s, unnest(range(0, least(1000, n - 199 - o))) AS j FROM b)),
a AS (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT r, p, sum(gap) OVER (PARTITION BY r ORDER BY p) AS island FROM (SELECT r, p, (coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p), 201) > 200)::INT AS gap FROM a)),
s AS (SELECT r, min(p) AS x, max(p) + 200 AS y FROM i GROUP BY r, island),
t AS (SELECT s.r, x, y, substring(h, 2 * lag(y, 1, 0) OVER (PARTITION BY s.r ORDER BY x) + 1, 2 * (x - lag(y, 1, 0) OVER (PARTITION BY s.r ORDER BY x))) AS before FROM s JOIN d ON d.r = s.r),
g AS (SELECT r, sum(y - x) AS gone, count(*) AS n_spans, max(y) AS last, string_agg(before, '' ORDER BY x) AS kept FROM t GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""

# --- 10

SPEAKS = "(?i)licen[sc]e|rights reserved"


def op10_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/language/thousand.

    The table has no names; texts that speak of a licence once in 400 characters or more, and licences by their legal terms, are taken as licence files.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    speaks = F.col("text").rlike(SPEAKS) & (F.regexp_count("text", F.lit(SPEAKS)) * 400 > F.length("text"))
    name = F.when(speaks | licences.is_licence_text(F.col("text")), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), name)
    return licences.scan_licences(docs.select("doc_id", path.alias("path"), "text"), key="doc_id")


def sql10() -> str:
    """The templates are put in as values."""
    texts = lambda x: "[" + ", ".join(f"'{t}'" for t in x) + "]::VARCHAR[]"
    rules = lambda own: f"{len(own)}, {texts(licences.needed(own))}, {texts(licences.barred(own))}"
    values = ", ".join(f"({k}, '{name}', '{text}', {rules(licences.terms(text))})" for k, (name, text) in enumerate(licences.TEMPLATES))
    variant = "CASE " + " ".join(f"WHEN lic = '{b}' AND list_contains(every, '{a}') THEN '{a}'" for a, b in licences.VARIANTS) + " ELSE lic END"
    # RE2 has no look-ahead: the tag is all that may belong to it, without its ending
    tag, title = r"SPDX-License-Identifier:\s*([A-Za-z0-9][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)*?)(?:-only|-or-later|\+)?(?:[^A-Za-z0-9.+-]|$)", licences.TITLE
    known = ", ".join(f"'{x}'" for x in sorted({x for x, _ in licences.TEMPLATES}))
    titles = "CASE title " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licences.TITLES.items()) + " END"
    split = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"
    return rf"""
WITH RECURSIVE t(tid, lic, txt, n_terms, needs, bars) AS (VALUES {values}), tt AS (SELECT tid, lic, term, count(*) AS tf FROM (SELECT tid, lic, unnest({split("txt")}) AS term FROM t) GROUP BY ALL), v AS (SELECT DISTINCT term FROM tt),
d AS (SELECT doc_id, text, source || '/' || lang || '/' || (doc_id // 1000)::VARCHAR AS dir, 400 * len(regexp_extract_all(text, '{SPEAKS}')) > length(text) AS f FROM documents),
n AS (SELECT count(*) AS n FROM d), df AS (SELECT term, count(DISTINCT doc_id) AS k FROM (SELECT doc_id, unnest({split("text")}) AS term FROM d) WHERE term IN (SELECT term FROM v) GROUP BY term),
idf AS (SELECT v.term, ln(1 + n / (1 + coalesce(k, 0))) AS idf FROM v CROSS JOIN n LEFT JOIN df ON df.term = v.term),
tw AS (SELECT tid, lic, tt.term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY tid)) AS w FROM tt JOIN idf ON idf.term = tt.term),
u AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM d UNION ALL SELECT doc_id, text FROM d WHERE f)),
ut AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest({split("unit")}) AS term FROM u) GROUP BY ALL),
uw AS (SELECT doc_id, unit, ut.term, (1 + ln(tf)) * coalesce(idf, ln(1 + n / 2)) AS w FROM ut CROSS JOIN n LEFT JOIN idf ON idf.term = ut.term),
nn AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
c AS (SELECT uw.doc_id, uw.unit, tid, lic, sum(uw.w * tw.w) / any_value(norm) AS cosine FROM uw JOIN tw ON tw.term = uw.term JOIN nn ON nn.doc_id = uw.doc_id AND nn.unit = uw.unit GROUP BY uw.doc_id, uw.unit, tid, lic),
r AS (SELECT c.*, n_terms FROM c JOIN t USING (tid) WHERE cosine >= {licences.LEAST} AND list_has_all({split("unit")}, needs) AND NOT list_has_any({split("unit")}, bars)),
b AS (SELECT doc_id, arg_min(r.lic, (r.lic = '{licences.GENERIC}', -round(cosine * 1000)::BIGINT, -n_terms, r.lic)) AS lic, arg_min(round(cosine * 1000)::BIGINT, (r.lic = '{licences.GENERIC}', -round(cosine * 1000)::BIGINT)) AS s, list(DISTINCT r.lic) AS every FROM r GROUP BY doc_id),
h AS (SELECT doc_id, s, {variant} AS lic FROM b),
w AS (SELECT doc_id, nullif(regexp_extract(text, '{tag}', 1), '') AS tag, lower(regexp_extract(text, '{title}', 1)) AS title FROM d),
y AS (SELECT doc_id, h.s, h.lic, CASE WHEN tag IN ({known}) THEN tag END AS tag, {titles} AS title FROM w LEFT JOIN h USING (doc_id)),
z AS (SELECT doc_id, coalesce(tag, nullif(lic, '{licences.GENERIC}'), title, lic) AS lic, CASE WHEN tag IS NULL AND (nullif(lic, '{licences.GENERIC}') IS NOT NULL OR title IS NULL) THEN s WHEN coalesce(tag, title, lic) IS NOT NULL THEN 1000 END AS s FROM y),
o AS (SELECT d.doc_id, dir, f, dir || '/' || CASE WHEN f THEN 'LICENSE-' || doc_id::VARCHAR ELSE doc_id::VARCHAR || '.txt' END AS path, lic, s FROM d LEFT JOIN z USING (doc_id)),
l AS (SELECT dir AS anc, arg_min(lic, (-s, lic)) AS lic FROM o WHERE f AND lic IS NOT NULL GROUP BY dir),
a AS (SELECT dir, dir AS anc, 0 AS up FROM (SELECT DISTINCT dir FROM d) UNION ALL SELECT dir, CASE WHEN contains(anc, '/') THEN regexp_replace(anc, '/[^/]*$', '') ELSE '' END, up + 1 FROM a WHERE anc <> ''),
k AS (SELECT a.dir, arg_min(l.anc, up) AS anc, arg_min(l.lic, up) AS lic FROM a JOIN l ON l.anc = a.anc GROUP BY a.dir)
SELECT doc_id, path, o.lic AS own_licence, s / 1000 AS similarity, CASE WHEN o.lic IS NULL THEN k.lic END AS inherited_licence, CASE WHEN o.lic IS NULL THEN k.anc END AS inherited_from, coalesce(o.lic, k.lic) AS licence FROM o LEFT JOIN k ON k.dir = o.dir"""

# --- 11


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = r"regexp_extract_all(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format("text")} AS w FROM documents),
s AS (SELECT count_if(len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark)),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, n_docs),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM i JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
y AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50"""


# --- 12


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- 13


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The checksum byte by byte, from a table made by its rule; near words share a text with one letter deleted, in one of them or in both.
SQL13 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+') AS w FROM documents),
o AS (SELECT doc_id, word, count(*) AS n FROM (SELECT r, doc_id, unnest(w) AS word FROM d) WHERE length(word) >= 6 GROUP BY r, doc_id, word),
b AS (SELECT o.*, list_transform(range(octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || word))), lambda i: ('0x' || substring(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS y FROM o),
h AS (SELECT word, n, xor(list_reduce(list_concat([4294967295], y), lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) AS h FROM b, crc),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substring(word, 1, h % length(word)) || substring(word, h % length(word) + 2) ELSE word END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS part FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.part = b.part AND a.i = b.i AND a.word <> b.word UNION SELECT v.word, x.word, x.n FROM v JOIN x ON x.part = v.word UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.part = v.word),
k AS (SELECT v.word, v.n, count(p.b)::BIGINT AS n_near, max(p.n) AS best_n, arg_min(p.b, (-p.n, encode(p.b))) AS best FROM v LEFT JOIN p ON p.a = v.word GROUP BY v.word, v.n),
f AS (SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM k),
c AS (SELECT word, word AS head, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.head WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(head, step) AS root FROM c GROUP BY word) USING (word)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_benchmark_decontamination, op3_quality_rules, op4_ngram_jaccard_join, op5_pii, op6_quality_classifier, op7_byte_level_bpe, op8_secret_scans, op9_suffix_dedup, op10_licence_scans, op11_ranked_search, op12_simhash_near_dedup, op13_spelling_variants)
}

SQL: dict[str, str] = {
    "op1_chat_formatting": SQL1, "op2_benchmark_decontamination": SQL2, "op3_quality_rules": SQL3, "op4_ngram_jaccard_join": SQL4, "op8_secret_scans": sql8(), "op9_suffix_dedup": SQL9, "op10_licence_scans": sql10(), "op11_ranked_search": SQL11, "op13_spelling_variants": SQL13,
}
