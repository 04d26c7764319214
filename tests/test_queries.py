"""Each registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recall_of_trained_indexes_by_brute_force(spark):
    """fit_recall against matrices: decoded vectors, all rows scored, top ten compared with the exact ones."""
    import numpy as np

    from tessera.operators.product import ProductIndex
    from tessera.plans import queries as q

    got = {r["index"]: (r.recall, r.n) for r in entry.queries()["fit_recall"](spark, SF).collect()}
    rows = q.vectors(spark, SF)
    table = rows.orderBy("id").collect()
    ids, x = np.array([r.id for r in table]), np.array([r.embedding for r in table], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = unit[ids % 100 == 0]

    def best(scores):
        return [set(ids[np.lexsort((ids, -np.round(s, 9)))[:10]].tolist()) for s in scores]

    truth = best(asked @ unit.T)
    for name, options in (("product", {}), ("product, balanced", {"use_opq": True})):
        index = ProductIndex(spark, 64, 16, 64, **options)
        index.fit(rows)
        turn = index.rotation if options else np.eye(64)
        y = unit @ turn
        decoded = np.hstack([b[((y[:, 4 * j : 4 * j + 4, None] - b.T[None]) ** 2).sum(1).argmin(1)] for j, b in enumerate(index.books)])
        found = best(asked @ turn @ (decoded * np.linalg.norm(x, axis=1)[:, None]).T)
        share = sum(len(a & b) for a, b in zip(found, truth, strict=True)) / (10 * len(asked))
        assert got[name] == (round(share, 6), 10 * len(asked))
    assert got["inverted, reranked"][0] >= max(0.8, got["inverted"][0])

def table_of(folder, source, shifts):
    """embeddings as a folder of parts: the table `source` once for each number its ids are shifted by."""
    os.makedirs(f"{folder}/embeddings.parquet")
    for k, shift in enumerate(shifts):
        duckdb.sql(f"COPY (SELECT vec_id + {shift} AS vec_id, embedding, label FROM '{source}/embeddings.parquet') TO '{folder}/embeddings.parquet/part-{k}.parquet' (FORMAT parquet)")
    return str(folder)


def sql_of(name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return con.sql(entry.oracle_sql()[name]).df()


def test_kmeans_step_covers_more_rows_than_models_train_on(spark, tmp_path, monkeypatch):
    from tessera.plans import training

    monkeypatch.setattr(training, "TRAIN_ROWS", 100)
    monkeypatch.setattr(training.training_sample, "__defaults__", (100,))
    folder = table_of(tmp_path, SF, (0, 1000, 2000))
    got = entry.queries()["kmeans_step"](spark, folder).toPandas()
    assert rows_of(got) == rows_of(sql_of("kmeans_step", folder))
    assert got[got.j == 0].n.sum() == spark.read.parquet(f"{folder}/embeddings.parquet").count()


def test_a_step_over_tasks_is_a_step_of_lloyd(spark):
    import numpy as np

    from tessera.functions import kernels
    from tessera.plans import training

    x = kernels.units(np.random.default_rng(3).standard_normal((9000, 16)))
    c = x[[0, 1, 2, 1]]  # the last is nobody's: its equal comes first
    rows = training.cluster_means(spark.createDataFrame([(v,) for v in x.tolist()], "embedding array<double>").repartition(3), c).collect()
    got = {(r.cluster_id, r.j): (r.center, r.n) for r in rows}
    near = kernels.nearest(x, c[:3])
    assert {k for k, _ in got} == {0, 1, 2}
    for k in range(3):
        assert np.allclose([got[k, j][0] for j in range(16)], x[near == k].mean(0)) and got[k, 0][1] == (near == k).sum()


def test_streaming_ingest_reads_a_folder_of_files(spark, tmp_path):
    folder = table_of(tmp_path, SF, (0, 1000, 2000))
    got = entry.queries()["streaming_ingest"](spark, folder).toPandas()
    assert len(got) and rows_of(got) == rows_of(sql_of("streaming_ingest", folder))
