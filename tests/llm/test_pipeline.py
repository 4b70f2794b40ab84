import duckdb
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as CP
from lectern.llm import bpe, pii, queries
from lectern.llm import classifier as C
from tests.conftest import ORACLE, SMALL
from tests.llm import test_decontaminate as decontaminate
from tests.llm import test_jaccard_join as join


def views(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", queries.SQL)
def test_queries_against_sql(spark, name):
    df = queries.QUERIES[name](spark, ORACLE)
    r = views(ORACLE).execute(queries.SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([tuple(x[i] for i in at) for x in r.fetchall()], key=repr)


def test_pipeline_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(CP.STAGES)
    assert list(stages) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_level_bpe"]
    # the classifier's decisions are those of its scores, and labelled clean documents stay
    a = stages["quality_classifier"](spark, docs, SMALL).cache()
    ids = {r.doc_id for r in a.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    good = [x.doc_id for x in labels if x.quality and not x.toxic]
    assert sum(i in ids for i in good) >= 0.97 * len(good) and sum(x.doc_id in ids for x in labels if not x.quality) == 0
    assert a.columns == list(CP.COLUMNS)
    # one document of each group
    b = stages["ngram_jaccard_join"](spark, a, SMALL).cache()
    pairs = [(i, rows[i].text) for i in ids]
    assert {r.doc_id for r in b.collect()} == {c for _, _, c, _ in join.brute(pairs)}
    # no window of the benchmark is left
    c = stages["benchmark_decontamination"](spark, b, SMALL).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in b.collect()]
    assert {r.doc_id for r in c.collect()} == {i for i, _, hit, _ in decontaminate.brute(kept, items) if not hit}
    # pseudonyms turn back
    d = stages["pii"](spark, c, SMALL).cache()
    key = pii.Feistel(queries.PII_KEY)
    for r in d.collect():
        assert r.text == pii.pseudonymise_text(rows[r.doc_id].text, key)[0] and r.n_chars == len(r.text)
    # tokens
    ref = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(queries.tokenizer()[0]), special_tokens={})
    texts = {r.doc_id: r.text for r in d.collect()}
    e = stages["byte_level_bpe"](spark, d, SMALL).collect()
    assert len(e) == len(texts) and all(list(r.tokens) == ref.encode_ordinary(texts[r.doc_id]) and r.round_trip for r in e)


def test_stages_with_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, "some plain words about things " * 3, None, None, None, 1), (2, None, "en", "s", 0, 2), (3, "", "en", "s", 0, 3), (None, None, None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in CP.STAGES:
            docs = stage(spark, docs, SMALL)
            assert docs.count() <= len(data)


def test_models_are_small():
    assert C.TRAIN_ROWS <= 20000
