import math

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalog
from tests.conftest import ORACLE


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ORACLE}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, ORACLE)
    rows = df.collect()
    assert rows
    if name in catalog.SQL:
        r = db.execute(catalog.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        assert sorted([tuple(plain(v) for v in x) for x in rows], key=repr) == sorted([tuple(plain(x[i]) for i in at) for x in r.fetchall()], key=repr)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_absent_modules_are_left_out(tmp_path, monkeypatch):
    (tmp_path / "faulty_part").mkdir()
    (tmp_path / "faulty_part" / "__init__.py").write_text("import no_such_library")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert not entry._present("lectern.nothing.queries") and not entry._present("no_such_module") and entry._present("lectern.plans.catalog")
    with pytest.raises(ModuleNotFoundError):
        entry._present("faulty_part.queries")


def test_shrunk_topics_against_a_loop(spark, db):
    from tests.test_operators import consolidate

    users = {}
    for user, title, a, b in db.execute("SELECT user_id, event_type, epoch_us(ts) / 1e6, epoch_us(ts) / 1e6 + value * 600 FROM events").fetchall():
        users.setdefault(user, []).append((title, a, b))
    rows = catalog.QUERIES["consolidate_topics_shrunk"](spark, ORACLE).collect()
    assert sorted((r.video_id, r.topic_id, r.title, r.start_s, r.end_s) for r in rows) == sorted((u, *t) for u, topics in users.items() for t in consolidate(topics))
    assert max(map(len, users.values())) > 12 >= max(int(r.topic_id[1:]) for r in rows)
