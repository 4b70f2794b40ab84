import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import acquisition, blocks, chunks, coverage, groups, intervals, metrics, opinions, retrieval, sections

PARAGRAPHS = [
    (0, "intro text before any link (dropped)"), (1, "https://youtu.be/AAAAAAAAAA1?t=3)."), (2, "The joint was loose"), (3, "I rebuilt it twice"),
    (4, "see https://www.youtube.com/watch?v=BBBBBBBBBB2 for part two"), (5, "This one is about wiring"),
]


def paragraphs(spark, rows=PARAGRAPHS):
    return spark.createDataFrame([("d", k, "", t) for k, t in rows], "doc string, para_no int, style string, text string")


def test_comment_and_opinion_blocks(spark):
    got = {r.video_id: r.comment for r in blocks.comments(paragraphs(spark)).collect()}
    assert got == {"AAAAAAAAAA1": "The joint was loose I rebuilt it twice", "BBBBBBBBBB2": "This one is about wiring"}
    got = blocks.opinions(paragraphs(spark)).collect()
    assert [(r.seq, r.paragraph) for r in got] == [(5, "This one is about wiring")]
    assert [r.link for r in blocks.links(paragraphs(spark)).orderBy("para_no").collect()] == ["https://www.youtube.com/watch?v=BBBBBBBBBB2"]


def test_captions(spark):
    rows = [(0, "Frame: a.jpg"), (1, "one"), (2, " "), (3, "two"), (4, "frame: b.jpg ")]
    assert {r.frame: r.caption for r in blocks.captions(paragraphs(spark, rows)).collect()} == {"a.jpg": "one two", "b.jpg": ""}
    rows = [(0, "frame_0001.jpg"), (1, "old"), (2, "frame_0002.jpg"), (3, "x"), (4, "frame_0001.jpg"), (5, "new"), (6, "more")]
    assert {r.frame: r.caption for r in blocks.caption_map(paragraphs(spark, rows)).collect()} == {"frame_0001.jpg": " new more", "frame_0002.jpg": " x"}
    rows = [(0, "Frame: Frame_0001.jpg"), (1, "Description: x"), (2, "Caption: y"), (3, "frame_0002.jpg"), (4, "Caption: z")]
    styled = paragraphs(spark, rows).withColumn("style", F.when(F.col("para_no").isin(0, 3), "Heading1").otherwise(""))
    assert [r.frame for r in blocks.processed_frames(styled, validate=5).collect()] == ["frame_0001.jpg"]
    assert sorted(r.frame for r in blocks.processed_frames(styled).collect()) == ["frame_0001.jpg", "frame_0002.jpg"]


def segments(spark, rows):
    return spark.createDataFrame([("v", k, float(a), float(b), t) for k, (a, b, t) in enumerate(rows)], "video_id string, seg_idx int, start double, end double, text string")


@pytest.mark.parametrize("seed", range(3))
def test_chunks_against_a_loop(spark, seed):
    rng, rows, t = random.Random(seed), [], 0.0
    for _ in range(120):
        d = rng.choice([1, 5, 30, 200])
        rows.append((t, t + d, "x" * rng.choice([0, 3, 40, 150])))
        t += d
    want, at, first, chars = [], -1, 0.0, 0
    for a, b, text in rows:
        n = len(text) + 31
        if at < 0 or b - first > 180 or chars + n > 300:
            at, first, chars = at + 1, a, n
        else:
            chars += n
        want.append(at)
    got = chunks.chunk_segments(segments(spark, rows), 180.0, 300).orderBy("seg_idx").collect()
    assert [r.chunk_index for r in got] == want and [r.text for r in got] == [x[2] for x in rows]


def test_thinning(spark):
    rows = [(k, k + 1, "y" * 9) for k in range(20)]  # 199 characters joined
    lines = segments(spark, rows).withColumn("line", F.col("text"))
    kept = [r.seg_idx for r in chunks.thin_lines(lines, 70).orderBy("seg_idx").collect()]
    assert kept == [0, 3, 6, 9, 12, 15, 18]
    assert chunks.thin_lines(lines, 1000).count() == 20
    # the cap may be hit before the lines fit
    assert [r.seg_idx for r in chunks.thin_lines(lines, 5, numbered=True).orderBy("seg_idx").collect()] == [0]


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), float(a := rng.randint(0, 300)), float(a + rng.randint(0, 20))) for _ in range(80)]
    want = []
    for k in "ab":
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if want and want[-1][0] == k and a <= want[-1][2] + 2:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([k, a, b])
    got = intervals.merge_intervals(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b", 2.0).collect()
    assert sorted([r.k, r.a, r.b] for r in got) == sorted(want)


def consolidate(topics, slack=2.0, most=12):
    out = []
    for t in sorted(topics, key=lambda t: (t[0].strip().lower(), t[1], t[2])):
        key = t[0].strip().lower()
        if out and out[-1][3] == key and t[1] <= out[-1][2] + slack:
            out[-1][2] = max(out[-1][2], t[2])
        else:
            out.append([t[0], t[1], t[2], key])
    while len(out) > most:
        k = min(range(len(out)), key=lambda i: out[i][2] - out[i][1])
        if k == 0:
            out[1][1] = min(out[1][1], out[0][1])
        else:
            out[k - 1][2] = max(out[k - 1][2], out[k][2])
        del out[k]
    return [(f"T{i + 1}", t[0], t[1], t[2]) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", range(4))
def test_topics_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.choice('aBcdefghijklmnopq')}", a := rng.randint(0, 400), a + rng.randint(1, 90)) for _ in range(40)]
    rows = list({(t.lower(), a, b) for t, a, b in rows})
    df = spark.createDataFrame([("v", t, "d", ["q"], float(a), float(b)) for t, a, b in rows], "video_id string, title string, description string, evidence_quotes array<string>, start_s double, end_s double")
    got = intervals.consolidate_topics(df).collect()
    assert [(r.topic_id, r.title, r.start_s, r.end_s) for r in sorted(got, key=lambda r: int(r.topic_id[1:]))] == consolidate(rows)
    assert all(len(r.evidence_quotes) <= 3 for r in got)


def test_ranges(spark):
    rows = [("v", 5, 2), ("v", 6, 8), ("v", 30, 99), ("v", 12, 12)]
    df = spark.createDataFrame(rows, "video_id string, start_idx int, end_idx int").withColumn("n", F.lit(40))
    got = sorted((r.start_idx, r.end_idx) for r in intervals.merge_ranges(df, ["video_id"], size="n").collect())
    assert got == [(2, 8), (12, 12), (30, 39)]


def test_groups_and_picks(spark):
    df = spark.createDataFrame([("v", f"f{k}", f"c{k}") for k in range(5)], "video_id string, frame string, caption string")
    got = groups.frame_groups(df, 3, 2).orderBy("first").collect()
    assert [r.group_id for r in got] == ["f0+f1+f2", "f2+f3+f4"]
    assert got[0].combined_caption == "Frame 1 (f0): c0\nFrame 2 (f1): c1\nFrame 3 (f2): c2"
    assert groups.frame_groups(df.limit(2), 3).count() == 0


def optimum(cost, n, penalty, least):
    best = {0: (0.0, [])}
    for e in range(least, n + 1):
        tried = [(best[s][0] + cost(s, e) + penalty, [*best[s][1], e]) for s in list(best) if e - s >= least]
        if tried:
            best[e] = min(tried)
    return best[n]


@pytest.mark.parametrize("seed", range(5))
def test_pelt_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.3, (rng.integers(6, 15), 4)) for m in rng.integers(-3, 3, 4)])
    cost = sections.RbfCost(x)
    for penalty in (0.5, 2.0, 15.0):
        total, _ = optimum(cost, len(x), penalty, 6)
        ends = sections.pelt(cost, len(x), penalty, 6, jump=1)
        got = sum(cost(a, b) + penalty for a, b in zip([0, *ends], ends))
        assert got == pytest.approx(total) and ends[-1] == len(x)
    assert len(sections.binary_segmentation(cost, len(x), 3)) == 3
    assert all(e % 5 == 0 for e in sections.pelt(cost, len(x), 0.5, 6)[:-1])


def test_sections(spark):
    rows = [("v", f"f{k:03d}", f"c{k}", [1.0, 0.0] if k < 20 else [0.0, 1.0]) for k in range(40)] + [("w", "f0", "c", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "video_id string, frame string, caption string, embedding array<double>")
    got = sections.sections(df, penalty=1.0).collect()
    assert sorted((r.video_id, r.start, r.end) for r in got) == [("v", 0, 20), ("v", 20, 40), ("w", 0, 1)]
    assert [r.section_id for r in got if r.video_id == "w"] == ["s000_0_1"]


def test_fallback_and_resume(spark):
    videos = spark.createDataFrame([("a",), ("b",)], "video_id string")
    comments = spark.createDataFrame([("a", 0, "x"), ("z", 1, "y")], "video_id string, comment_idx int, comment string")
    got = sorted((r.video_id, r.comment_idx, r.fallback) for r in retrieval.comments_of(videos, comments).collect())
    assert got == [("a", 0, False), ("b", 0, True), ("b", 1, True)]
    units = spark.createDataFrame([("a", "T1"), ("a", "T2")], "video_id string, unit_id string")
    assert [r.unit_id for r in retrieval.unfinished(units, units.limit(1)).collect()] == ["T2"]


def test_top_k_of_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[5] = x[6]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = retrieval.top_k_of_vectors(df.where("id % 10 = 0"), df.withColumnRenamed("id", "r"), 4, "id", "r", "v", size=(3, 7)).collect()
    for q in range(0, 60, 10):
        want = sorted(range(60), key=lambda k: (-sum(a * b for a, b in zip(x[q], x[k])), k))[:4]
        assert [r.r for r in sorted((r for r in got if r.id == q), key=lambda r: r.rank)] == want


CANDIDATES = [
    ("v", "T1", 0, True, 80.0, "r", "c1", "u"), ("v", "T1", 1, False, 90.0, "r", "c2", "u"), ("v", "T2", 0, True, 60.0, "r", "c1", "u"), ("v", "T2", 1, True, 59.0, "r", "c3", "u"),
    ("v", "T1", 2, True, 70.0, "again", "c1", "u"), ("w", "T1", 0, False, 10.0, "", " c1 ", "u"),
]


def candidates(spark):
    return spark.createDataFrame(CANDIDATES, "video_id string, unit_id string, cand_idx int, correlated boolean, score double, reason string, comment string, url string")


def test_coverage(spark):
    c = coverage.coverage(candidates(spark))
    got = {(r.video_id, r.comment): (r.n_units, r.max_score) for r in c.collect()}
    assert got == {("v", "c1"): (2, 70.0), ("v", "c2"): (0, 0.0), ("v", "c3"): (0, 0.0), ("w", " c1 "): (0, 0.0)}
    assert [r.cand_idx for r in coverage.kept_comments(candidates(spark)).where("unit_id = 'T1'").orderBy("rank").collect()] == [0, 2]
    s = {r.video_id: r for r in coverage.coverage_summary(c, candidates(spark)).collect()}
    assert s["v"].n_correlated == 1 and s["v"].percent == 20.0 and coverage.coverage_summary(c).first().percent is None


def test_metrics_null_rules(spark):
    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    m = metrics.video_metrics(videos, metrics.distinct_comments(candidates(spark)), metrics.score_stats(candidates(spark)))
    got = {r.video_id: r for r in m.collect()}
    assert got["v"].comments == 3 and got["v"].corr_n_over == 4 and got["v"].corr_median == 70.0
    assert got["x"].comments == 0 and got["x"].corr_avg is None
    a = metrics.set_aggregate(m.withColumns({c: F.lit(0) for c in ("frames", "transcript_words", "topics")}), "s").first()
    assert a.num_videos == 3 and a.avg_comments == pytest.approx(4 / 3) and a.avg_corr_avg == pytest.approx((71.8 + 10) / 2)


def test_extra_columns_last_row_wins(spark):
    extra = spark.createDataFrame([("v", 1, "a", "1"), ("v", 2, "b", None), (None, 3, "c", "3")], "video_id string, n int, likes string, frames string")
    base = spark.createDataFrame([("v", 7), ("w", 8)], "video_id string, frames int")
    got = {r.video_id: r.asDict() for r in metrics.with_extra(base, extra, "n", ["frames", "likes", "likes", "absent"]).collect()}
    assert got == {"v": {"video_id": "v", "frames": 7, "likes": "b"}, "w": {"video_id": "w", "frames": 8, "likes": None}}


def test_opinions(spark):
    rows = [("l", 0, "like", "Clear steps", "yes: hands", "o", "Yes", "a sensor"), ("l", 1, "dislike", "other", "no", "o", "no", "yes"), ("l", 2, "nothing", "clear steps", "no", "o", "they reasoned", "no"), ("l", 3, "liked", "clear steps", "no", "Embodied", "", "")]
    df = spark.createDataFrame(rows, "link string, seq int, sentiment_reply string, reason_reply string, embodied_reply string, other_reply string, logical_reply string, logical_embodied_reply string")
    labels = opinions.label(df)
    assert [r.other_paradigm for r in labels.orderBy("seq").collect()] == [None, "o", None, None]
    c = opinions.label_counts(labels).first()
    assert (c["like"], c.dislike, c.embodied_like, c.logical, c.logical_embodied) == (3, 0, 1, 2, 1)
    assert opinions.label_counts(opinions.label(df, compat=False)).first().dislike == 1
    assert [(r.reason, r.n) for r in opinions.reason_counts(labels).orderBy("rank").collect()] == [("clear steps", 2), ("other", 1)]


@pytest.mark.parametrize("n,files", [(10, 3), (7, 7), (5, 1), (0, 2)])
def test_url_buckets(spark, n, files):
    df = spark.createDataFrame([(k, f"u{k}") for k in range(n)], "seq int, url string").repartition(3)
    got = [(r.rn, r.bucket) for r in acquisition.url_buckets(df, "seq", files).orderBy("seq").collect()]
    assert got == [(k + 1, k // (n // files + 1)) for k in range(n)]


def test_logs(spark):
    u = lambda *x: spark.createDataFrame([(v,) for v in x], "url string")
    left = acquisition.remaining(u("a", "a", "b", "c"), u("b"), u("c"))
    assert [r.url for r in left.collect()] == ["a", "a"]


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_partitions_do_not_matter(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [("v", float(k % 7), float(k % 7 + k % 3)) for k in range(50)]
        got = intervals.merge_intervals(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()
        assert [(r.a, r.b) for r in got] == [(0.0, 8.0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_absorbing_by_heap():
    """Equal to rebuilding the list at each step; 100,000 topics take time in proportion."""
    import random
    import time

    rng = random.Random(4)
    for _ in range(200):
        start = [rng.randint(0, 50) for _ in range(rng.randint(1, 30))]
        end = [s + rng.randint(-2, 9) for s in start]
        most, want = rng.randint(1, 12), [[s, e, k] for k, (s, e) in enumerate(zip(start, end))]
        while len(want) > most:
            spans = [e - s for s, e, _ in want]
            k = spans.index(min(spans))
            if k:
                want[k - 1][1] = max(want[k - 1][1], want[k][1])
            else:
                want[1][0] = min(want[0][0], want[1][0])
            del want[k]
        stay = intervals.absorb_shortest(start, end, most)
        assert [[start[k], end[k], k] for k in stay] == want
    took = []
    for n in (25_000, 100_000):
        start = [float(k * 10) for k in range(n)]
        end = [s + rng.random() for s in start]
        begin = time.process_time()
        assert len(intervals.absorb_shortest(start, end, 12)) == 12
        took.append(time.process_time() - begin)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 10


class WholeCost:
    """The cost from all kernels at once."""

    def __init__(self, x):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        off = d[np.triu_indices(len(x), 1)]
        middle = float(np.median(off)) if len(off) else 0.0
        self.k = np.exp(-np.clip(d / middle if middle else d, 1e-2, 1e2))
        np.fill_diagonal(self.k, 1)
        self.middle = middle

    def __call__(self, a, b):
        return (b - a) - self.k[a:b, a:b].sum() / (b - a)

    def keep_from(self, first):
        pass


def test_costs_block_by_block(monkeypatch):
    rng = np.random.default_rng(8)
    for n, block, kept in ((40, 7, 50), (97, 16, 100), (130, 128, 1 << 20), (3, 2, 1)):
        monkeypatch.setattr(sections, "BLOCK", block)
        monkeypatch.setattr(sections, "KEPT", kept)
        x = rng.normal(size=(n, 5)) + np.repeat(rng.normal(size=(4, 5)) * 3, -(-n // 4), axis=0)[:n]
        whole, cost = WholeCost(x), sections.RbfCost(x)
        assert abs(cost.middle - whole.middle) < 1e-9 * whole.middle
        for b in sorted(rng.integers(1, n + 1, 15)):
            for a in sorted(rng.integers(0, b, 4)):
                assert abs(cost(int(a), int(b)) - whole(int(a), int(b))) < 1e-8
        a, b = 1, n - 1
        left, right = cost.splits(a, b)
        for k in range(a, b + 1):
            assert abs(left[k - a] - (whole(a, k) if k > a else 0)) < 1e-8 and abs(right[k - a] - (whole(k, b) if b > k else 0)) < 1e-8
        if n > 20:
            for penalty in (0.2, 1.0, 5.0):
                assert sections.pelt(sections.RbfCost(x), n, penalty, 6) == sections.pelt(whole, n, penalty, 6)
    assert sections.RbfCost(np.ones((30, 2))).middle == 0


def test_many_frames_take_little_memory():
    import subprocess
    import sys

    script = """
import resource
import numpy as np
from lectern.operators import sections
rng = np.random.default_rng(1)
x = np.repeat(rng.normal(size=(8, 64)), 2500, axis=0) + 0.3 * rng.normal(size=(20000, 64))
print(*sections.section_ends(x))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    import os

    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=600)
    ends, peak = done.stdout.strip().split("\n")
    assert ends == "2500 5000 7500 10000 12500 15000 17500 20000" and int(peak) < 500, done.stdout + done.stderr


def test_nearest_rows_by_products_and_sums():
    """Ties, copies, missing numbers and long vectors: the same rows as by sorting all sums."""
    import numpy as np

    from lectern.operators.retrieval import nearest

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(300, 16))
    b[50:90] = b[7]
    b[100:110] = b[7] + 1e-8
    b[200, 3] = np.nan
    a[3] = b[7]
    for scale in (1.0, 1e6):
        sims = np.zeros((len(a), len(b)))
        for d in range(16):
            sims += (a * scale)[:, d, None] * b[None, :, d]
        for k in (1, 5, 45, 300, 400):
            i, j, found = nearest(a * scale, b, k)
            top = np.argsort(-np.round(sims, 6), axis=1, kind="stable")[:, :k]
            assert (j.reshape(len(a), -1) == top).all() and np.array_equal(found.reshape(top.shape), np.take_along_axis(sims, top, 1), equal_nan=True)
