import json
import os

import pytest

from lectern.sources import search

PAGES = {  # ids by page
    "cats": [["a", "b", "a"], ["b", "c"], ["d"], ["e"]],
    "dogs": [["x"]],
    "été": [[], ["y", "z"]],
    "none": [],
}


def setup(spark, tmp_path, size=1):
    for phrase, pages in PAGES.items():
        home = tmp_path / "pages" / search.name_of(phrase)
        home.mkdir(parents=True)
        for k, ids in enumerate(pages):
            token = "first" if k == 0 else f"t{k}"
            (home / f"{token}.json").write_text(json.dumps({"items": [{"video_id": i, "title": f"{i}, {k}"} for i in ids], "next": f"t{k + 1}" if k + 1 < len(pages) else None}))
    phrases = spark.createDataFrame([(p,) for p in [*PAGES, "cats"]] + [(None,)], "phrase string")
    search.register(spark)
    return {"path": str(tmp_path / "pages"), "cache": str(tmp_path / "cache"), "pages": "5", "target": "4"} | search.prepare(phrases, str(tmp_path / "phrases"), size)


WANT = [("cats", 0, "a", "a 0"), ("cats", 1, "b", "b 0"), ("cats", 2, "c", "c 1"), ("cats", 3, "d", "d 2"), ("dogs", 0, "x", "x 0"), ("été", 0, "y", "y 1"), ("été", 1, "z", "z 1")]


def calls(tmp_path):
    return {f"{d}/{f}" for d in os.listdir(tmp_path / "cache") for f in os.listdir(tmp_path / "cache" / d)}


@pytest.mark.parametrize("size", [1, 3, 10])
def test_batch(spark, tmp_path, size):
    options = setup(spark, tmp_path, size)
    assert options["n_slices"] == str(-(-4 // size))
    found = spark.read.format("recorded_search").options(**options).load()
    assert sorted(map(tuple, found.collect())) == WANT
    # the target is met on the third page of cats, so the fourth is not asked for
    assert len(calls(tmp_path)) == 3 + 1 + 2 + 1


def test_runs_of_a_stream_go_on(spark, tmp_path):
    """Each run takes a quota; all of them give what one would, and no page is asked for twice."""
    options = setup(spark, tmp_path)
    out, state, sizes = str(tmp_path / "out"), str(tmp_path / "state"), []
    for _ in range(8):
        rows = spark.readStream.format("recorded_search").options(**options, quota="3").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        sizes.append(spark.read.parquet(out).count())
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == WANT
    assert sizes[0] < sizes[1] <= sizes[-1] == len(WANT)
    assert len(calls(tmp_path)) == 7


def test_a_repeated_batch_reads_the_cache(spark, tmp_path):
    options = setup(spark, tmp_path)
    first = spark.read.format("recorded_search").options(**options).load().collect()
    for d, _, fs in os.walk(tmp_path / "pages"):
        for f in fs:
            os.remove(os.path.join(d, f))
    assert sorted(spark.read.format("recorded_search").options(**options).load().collect()) == sorted(first)


def test_recording(spark, tmp_path):
    rows = spark.createDataFrame([("p", k, f"v{k % 4}", None if k == 2 else f"t{k}") for k in range(7)], "phrase string, position int, video_id string, title string")
    assert search.record(rows, str(tmp_path / "r"), 3) == 3
    page, token, ids = search.Recorded(str(tmp_path / "r")), None, []
    while True:
        got = page.page("p", token)
        ids += [x["video_id"] for x in got["items"]]
        token = got["next"]
        if token is None:
            break
    assert ids == [f"v{k % 4}" for k in range(7)]
    assert page.page("other", None) == {"items": [], "next": None}
