from lectern.plans import file_queries, model_queries
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_records_are_not_written_by_one_task(spark, monkeypatch):
    seen, real = [], file_queries.sinks.append_json
    monkeypatch.setattr(file_queries.sinks, "append_json", lambda rows, path: (seen.append(plan(rows)), real(rows, path)))
    file_queries.result_files(spark, SMALL)
    assert len(seen) == 2 and not any("SinglePartition" in p for p in seen)


def test_captions_stay_in_arrow(spark):
    """Pages go to Python once, and their columns are not made objects as a whole."""
    p = plan(model_queries.merged_captions(spark, SMALL))
    assert "MapInArrow" in p and "MapInPandas" not in p and "caption_b" not in p.split("MapInArrow")[1].split("\n")[0]


def test_media_are_not_listed_by_the_driver(spark):
    p = plan(file_queries.media_probes(spark, SMALL))
    assert p.count("MapInArrow") >= 2 and "binaryFile" not in p
