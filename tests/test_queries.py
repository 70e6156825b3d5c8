"""Every registered query against its SQL on the smallest tables; those without SQL give rows."""

from __future__ import annotations

import pytest

from provquill import plans

from .oracle import connect, same

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.oracle_sql()) <= set(e.queries())


def test_store_edges_of_every_part(spark, sf_dir):
    from provquill import plans

    rows = plans.queries()["j01_store_edges"](spark, sf_dir).collect()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert {r.path for r in rows} == {str(r.p_partkey) for r in part.select("p_partkey").collect()} and {r.nodes for r in rows} == {"a|b"}


def test_edit_rates_of_whole_texts(spark, sf_dir):
    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    texts = {r.item_id: "".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.item_id, r.other): r.rate for r in QUERIES["f02_edit_rate"](spark, sf_dir).collect()}
    assert got == {(i, i + 1): round(edits(texts[i], texts[i + 1]) / max(len(texts[i]), len(texts[i + 1])), 6) for i in texts if i + 1 in texts}
