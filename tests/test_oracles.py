"""Models of several steps against their DuckDB SQL on small random tables."""

import random

import duckdb
import pytest

from grovekit.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rnd = tmp_path_factory.mktemp("oracles"), random.Random(5)
    lines = [
        (i, rnd.randint(1, 7), float(rnd.randint(1, 50)), rnd.randint(0, 10) / 100, rnd.randint(0, 8) / 100, rnd.uniform(900, 9000), rnd.choice("ANR"))
        for i in range(500)
    ]
    lines = [(*x[:5], x[5] * x[1], "A" if x[2] < 20 and rnd.random() < 0.8 else x[6]) for x in lines]
    schema = "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(str(path / "lineitem.parquet"))
    vectors = [(i, [rnd.gauss(i % 10, 0.3) for _ in range(64)], i % 10) for i in range(80)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    return path


@pytest.mark.parametrize("name", ["ctree_train_nodes", "rtree_train_nodes", "gbm_predict_2stage", "kmeans_init_random", "kmeans_init_plusplus", "kmeans_embeddings"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("lineitem", "embeddings"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    expected = con.sql(ORACLES[name])
    ours = QUERIES[name](spark, str(folder))
    assert sorted(ours.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in ours.columns]
    assert sorted(map(str, (tuple(r) for r in ours.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in expected.fetchall())
