import math
import random

import numpy as np
import pytest

from lectern.llm import classifier as C


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(30, 120))]
        quality, toxic = 1, 0
        if k % 7 == 0:
            quality, w = 0, [w[0]] * len(w)
        elif k % 5 == 0:
            toxic, w[3] = 1, rng.choice(["vileness", "vilelike", "horrid"])
        docs.append((k, " ".join(w), f"h{k % 3}", f"h{k % 3}/p{k % 6}"))
        labels.append((k, quality, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500)
    d, _ = frames(spark, docs, labels)
    _, known = frames(spark, docs, [x for x in labels if x[0] < 1000])
    models = C.train(d, known)
    scored = C.score(d, models)
    got = {r.doc_id: r.kept for r in C.classify(scored, C.site_posteriors(scored)).collect()}
    held = [(got[i], q == 1 and t == 0) for i, q, t in labels if i >= 1000]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(a for a, b in held if b)  # clean ones stay


def test_training_rows_are_bounded_and_stable(spark):
    docs, labels = corpus(300)
    d, known = frames(spark, docs, labels)
    a, b = C.train(d, known, rows=120), C.train(d.repartition(7), known.repartition(5), rows=120)
    assert np.allclose(a["bad"].shape, b["bad"].shape) and (a["toxic"].words == b["toxic"].words).all()


def test_shrinkage(spark):
    rows = [("a", "a/1", 3.0)] * 400 + [("b", "b/1", -3.0)] * 400 + [("c", "c/1", -3.0)] + [(None, None, 3.0)] * 3
    scored = spark.createDataFrame(rows, "host string, path string, logit_doc double")
    s = {r.path: r for r in C.site_posteriors(scored).collect()}
    rate = s["a/1"].global_rate
    assert s["b/1"].path_rate < 0.1 < 0.9 < s["a/1"].path_rate
    # one document moves its site less than four hundred do
    assert s["b/1"].path_rate < s["c/1"].path_rate < rate
    assert s[None].path_n == 3


@pytest.mark.parametrize("labels", [[], [(1, None, 0)], [(1, 1, 0), (2, 1, 0), (None, 0, 0)]])
def test_without_labels_or_with_one_class(spark, labels):
    docs = [(1, "some words here", "h", "h/p"), (2, None, None, None), (3, "", "h", "h/q"), (1, "some words here", "h", "h/p")]
    d, known = frames(spark, docs, labels)
    d = d.selectExpr("*", "'x' AS kept", "0 AS p_good", "'y' AS host_rate", "1 AS path_rate", "2 AS path_n", "3 AS site_shift", "4 AS logit_doc", "5 AS other")
    models = C.train(d, known)
    scored = C.score(d, models)
    rows = C.classify(scored, C.site_posteriors(scored)).select("kept", "p_good", "host_rate", "path_rate", "path_n", "site_shift", "other").collect()
    assert len(rows) == 4 and all(0 < r.p_good < 1 and r.kept == (r.p_good >= 0.5) and r.other == 5 for r in rows)
    assert C.classify(C.score(d.limit(0), models), C.site_posteriors(scored)).collect() == []


def test_empty_sites(spark):
    none = spark.createDataFrame([], "host string, path string, logit_doc double")
    assert C.site_posteriors(none).collect() == []


def posteriors(rows, low=2.0, high=1e6):
    """Rates of hosts and paths, from (host, path, log-odds), by loops."""
    p = [1 / (1 + math.exp(-x)) for _, _, x in rows]
    rate = sum(p) / len(p)

    def strength(sites, prior):
        n = sum(len(v) for v in sites.values())
        seen = sum(len(v) * (sum(v) / len(v) - prior[k]) ** 2 for k, v in sites.items())
        noise = sum(len(v) * prior[k] * (1 - prior[k]) for k, v in sites.items()) / n
        spread = (seen - len(sites) * noise) / max(n - len(sites), 1)
        return min(max(noise / spread - 1, low), high) if spread > 0 else high

    hosts, paths = {}, {}
    for (h, path, _), x in zip(rows, p):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, path), []).append(x)
    s = strength(hosts, dict.fromkeys(hosts, rate))
    host = {h: (s * rate + sum(v)) / (s + len(v)) for h, v in hosts.items()}
    s = strength(paths, {k: host[k[0]] for k in paths})
    return rate, host, {k: (s * host[k[0]] + sum(v)) / (s + len(v)) for k, v in paths.items()}


def test_query_against_loops(spark):
    from lectern.llm.queries import QUERIES
    from tests.conftest import ORACLE

    got = QUERIES["op6_quality_classifier"](spark, ORACLE).collect()
    rate, host, path = posteriors([(r.host, r.path, r.logit_doc) for r in got])
    odds = lambda p: math.log(p / (1 - p))
    for r in got:
        assert r.host_rate == pytest.approx(host[r.host]) and r.path_rate == pytest.approx(path[r.host, r.path])
        want = 1 / (1 + math.exp(-(r.logit_doc + odds(r.path_rate) - odds(rate))))
        assert r.p_good == pytest.approx(want) and r.kept == (r.p_good >= 0.5)


def test_logits_written_out():
    """Log-odds of a text from the presence of its words and beginnings, and its shape, one text at a time."""
    import pyarrow as pa

    from lectern.llm.textkit import slabs

    docs, _ = corpus(40)
    texts = [d[1] for d in docs] + [None, "", "word"]
    together = [C.features(s) for s in slabs(pa.array(texts), 1 << 20)]
    (shape, buckets, first), = together
    for k, t in enumerate(texts):
        own_shape, own_buckets, own_first = C.features(next(slabs(pa.array([t], pa.string()))))
        assert np.allclose(own_shape[0], shape[k]) and own_buckets.tolist() == buckets[first[k] : first[k + 1]].tolist()
        w = (t or "").split()
        assert len(own_buckets) <= len({*w}) + len({x[:4] for x in w if len(x) > 4}) + len({x[:5] for x in w if len(x) > 5})
        assert shape[k][0] == pytest.approx(math.log1p(len(w)))
    model = C.fit(shape, buckets, first, np.array([k % 7 == 0 for k in range(len(texts))], float))
    for k in range(len(texts)):
        weight = dict(zip(model.words.tolist(), model.weights.tolist()))
        want = model.bias + sum((shape[k][j] - model.mean[j]) / model.scale[j] * model.shape[j] for j in range(len(C.SHAPE))) + sum(weight.get(b, 0) for b in buckets[first[k] : first[k + 1]].tolist())
        assert model.logits(shape, buckets, first)[k] == pytest.approx(want)


def test_repeated_labelled_rows_and_a_very_long_text(spark):
    docs, labels = corpus(60)
    long_ = " ".join(f"w{k}" for k in range(1_200_000))
    d, known = frames(spark, [docs[0]] * 500 + docs + [(1000, long_, None, None)], labels)
    a, b = C.train(d, known), C.train(frames(spark, docs, labels)[0], known)
    assert np.allclose(a["bad"].shape, b["bad"].shape)
    assert len(long_) > 9_000_000 and C.score(d.where("doc_id = 1000"), a).first().logit_doc is not None
