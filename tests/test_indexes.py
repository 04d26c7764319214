"""The four indexes: results, recall, changes, freezing, storage, streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators.product import InvertedIndex, ProductIndex
from tessera.operators.scalar import ResidualIndex, ScalarIndex
from tessera.operators.topk import exact_topk, recall
from tessera.plans import training
from tessera.sources import binary, notes, store
from tessera.streaming.ingest import encoded_stream, ingest


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def gaussian(n, d, seed):
    return unit(np.random.default_rng(seed).standard_normal((n, d)))


def clustered(n, d, clusters, seed, noise=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, d))
    return unit(centers[rng.integers(clusters, size=n)] + noise * rng.standard_normal((n, d)))


def frame(spark, x, name="id", first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], f"{name} long, embedding array<float>")


def share(spark, index, x, q, k=10, **options):
    found = index.search_batch(frame(spark, q, "query_id"), k, **options)
    return recall(found, exact_topk(frame(spark, x), frame(spark, q, "query_id"), k)).first().recall


def hits(df):
    return [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]


def made(spark, kind, x):
    """An index of each kind with rows 0, 1, ... in it."""
    d = x.shape[1]
    index = {
        "scalar": lambda: ScalarIndex(spark, d, 4),
        "prod": lambda: ScalarIndex(spark, d, 3, use_prod=True),
        "residual": lambda: ResidualIndex(spark, d, 3, 3),
        "product": lambda: ProductIndex(spark, d, 8, 16),
        "inverted": lambda: InvertedIndex(spark, d, 4, 8, 16, keep_full=True),
    }[kind]()
    if hasattr(index, "fit"):
        index.fit(x, 4)
    index.add_batch(frame(spark, x))
    return index


KINDS = ["scalar", "prod", "residual", "product", "inverted"]


def test_scalar_recall_rises_with_bits(spark):
    x, q = gaussian(800, 64, 1), gaussian(20, 64, 2)
    found = []
    for bits in (2, 3, 4):
        index = ScalarIndex(spark, 64, bits)
        index.add_batch(frame(spark, x))
        found.append(share(spark, index, x, q))
    assert found[0] >= 0.5 and found[1] >= 0.65 and found[2] >= 0.8 and found == sorted(found)


def test_residual_is_as_good_as_one_stage_and_reranks(spark):
    x, q = gaussian(800, 64, 4), gaussian(20, 64, 5)
    one, two = ScalarIndex(spark, 64, 3), ResidualIndex(spark, 64, 3, 3)
    for index in (one, two):
        index.add_batch(frame(spark, x))
    assert share(spark, two, x, q) >= share(spark, one, x, q) - 0.02
    full, fast = two.search_batch(frame(spark, q, "query_id"), 10), two.search_batch(frame(spark, q, "query_id"), 10, rerank_M=200)
    assert recall(fast, full).first().recall >= 0.8
    with pytest.raises(ValueError, match="rerank_M"):
        two.search(q[0], 10, rerank_M=5)


def test_inverted_recall_floors(spark):
    x, q = clustered(3000, 64, 32, 17), gaussian(30, 64, 73)
    index = InvertedIndex(spark, 64, 32, 16, 128, keep_full=True)
    index.fit(x, 8)
    index.add_batch(frame(spark, x))
    assert share(spark, index, x, q, nprobe=8, rerank_candidates=100) >= 0.9
    assert share(spark, index, x, q, nprobe=8) >= 0.45
    plain = ProductIndex(spark, 64, 16, 128)
    plain.fit(x, 8)
    plain.add_batch(frame(spark, x))
    assert share(spark, index, x, q, nprobe=32) >= share(spark, plain, x, q) - 0.02


def test_norms_count_before_the_pool(spark):
    x = clustered(400, 64, 10, 3) * np.linspace(0.2, 10.0, 400, dtype=np.float32)[:, None]
    index = InvertedIndex(spark, 64, 8, 8, 32, keep_full=True)
    index.fit(x, 6)
    index.add_batch(frame(spark, x))
    q = gaussian(5, 64, 9)
    got = index.search_batch(frame(spark, q, "query_id"), 10, nprobe=8, rerank_candidates=40)
    want = {(j, int(i)) for j, s in enumerate(q @ x.T) for i in np.argsort(-s)[:10]}
    assert len(want & {(r.query_id, r.id) for r in got.collect()}) > 0.8 * len(want)


def test_batch_equals_single_and_zero_queries_give_nothing(spark):
    x, q = clustered(300, 32, 6, 1), clustered(4, 32, 6, 2)
    index = made(spark, "inverted", x)
    q[2] = 0
    rows = index.search_batch(frame(spark, q, "query_id"), 5, nprobe=2).orderBy("query_id", "rank").collect()
    for j in range(4):
        got = [(r.id, round(r.score, 9)) for r in rows if r.query_id == j]
        assert got == [(i, round(s, 9)) for i, s in index.search(q[j], 5, nprobe=2)]
    assert not [r for r in rows if r.query_id == 2]


@pytest.mark.parametrize("literal", [1000, 0])
def test_one_query_is_reranked_like_many(spark, monkeypatch, literal):
    monkeypatch.setattr("tessera.operators.index.LITERAL_IDS", literal)
    x = clustered(400, 16, 6, 3)
    two = ResidualIndex(spark, 16, 2, 3)
    inverted = InvertedIndex(spark, 16, 4, 4, 16, keep_full=True)
    inverted.fit(x, 3)
    for index, options in ((two, {"rerank_M": 30}), (inverted, {"nprobe": 2, "rerank_candidates": 30})):
        index.add_batch([f"v{i:03}" for i in range(400)], np.concatenate((x[:200], x[:200])))  # every score is a tie
        rows = index.search_batch(frame(spark, x[:3], "query_id"), 5, **options).collect()
        for j in range(3):
            many = sorted((r.rank, r.id, r.score) for r in rows if r.query_id == j)
            one = index.search(x[j], 5, **options)
            assert [i for i, _ in one] == [i for _, i, _ in many]
            assert np.allclose([s for _, s in one], [s for *_, s in many])
        assert index.search(x[0], 5, filter_ids=["nobody"], **options) == []


@pytest.mark.parametrize("kind", KINDS)
def test_filter_delete_and_edges(spark, kind):
    x = clustered(120, 32, 5, 8)
    index = made(spark, kind, x)
    q = x[3]
    everything = index.search(q, 500, **({"nprobe": 4} if kind == "inverted" else {}))
    assert len(everything) == len(index) == 120
    some = index.search(q, 5, filter_ids=[1, 3, 7, 999, "x"])
    assert {i for i, _ in some} <= {1, 3, 7} and len(some) in (1, 2, 3)
    assert index.search(q, 5, filter_ids=[]) == index.search(q, 5, filter_ids=[12345]) == []
    assert index.search(np.zeros(32), 5) == []
    with pytest.raises(ValueError, match="k is 0"):
        index.search(q, 0)
    assert index.delete(3) and not index.delete(3) and len(index) == 119
    assert 3 not in {i for i, _ in index.search(q, 200)}
    with pytest.raises(ValueError, match="id"):
        index.add_batch([4], x[:1])
    with pytest.raises(ValueError, match="id"):
        index.add_batch([500, 500], x[:2])
    with pytest.raises(ValueError, match="finite"):
        index.add_batch(spark.createDataFrame([(900, [float("nan")] * 32)], "id long, embedding array<float>"))
    with pytest.raises(ValueError, match="shape"):
        index.add_batch([901], np.zeros((1, 31)))
    index.add(902, x[0])
    assert len(index) == 120 and index.stats()["n"] == 120
    index.compact()
    assert len(index.segments) == 1 and len(index) == 120


def test_segments_without_the_ids_are_left_alone(spark):
    index = ScalarIndex(spark, 16)
    for part in range(3):
        index.add_batch(list(range(10 * part, 10 * part + 10)), gaussian(10, 16, part))
    before = list(index.segments)
    late = index.rows  # planned before, read after
    assert index.delete(11, 12, 999) and index.segments[:2] == [before[0], before[2]] and len(index) == 28
    assert late.count() == 30
    index.vacuum()
    from pathlib import Path

    assert [Path(p.removeprefix("file:")).exists() for p in before] == [True, False, True] and len(index) == 28
    assert sorted(r.id for r in index.conflicts(spark.createDataFrame([(5, None), (11, None), (77, None), (77, None)], "id long, embedding array<float>")).collect()) == [5, 77]


def test_many_queries_and_few_are_scored_alike(spark):
    x = clustered(300, 32, 6, 8)
    for kind in ("product", "inverted"):
        index = made(spark, kind, x)
        options = {"nprobe": 2} if kind == "inverted" else {}
        many = {}
        for r in index.search_batch(frame(spark, x[:40], "query_id"), 5, **options).collect():
            many.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
        for j in (0, 17, 39):
            few = [(i, round(s, 9)) for i, s in index.search(x[j], 5, **options)]
            assert few == many[j]


def test_subspaces_are_trained_alike_in_tasks_and_on_the_driver(spark, monkeypatch):
    x = clustered(400, 24, 5, 3)
    here = training.train_books(x, 6, 8, 10, 3)
    monkeypatch.setattr(training, "SMALL_SAMPLE", 0)
    assert np.array_equal(training.train_books(x, 6, 8, 10, 3, spark), here)


def test_equal_indexes_have_equal_digests(spark, tmp_path):
    """Building and saving twice gives the same rows, models and numbers."""
    import json

    x = clustered(200, 32, 5, 8)
    for kind in KINDS:
        found = []
        for k in range(2):
            store.save(made(spark, kind, x), f"file://{tmp_path}/{kind}{k}")
            at = store.current(spark, f"file://{tmp_path}/{kind}{k}")
            found.append(json.loads(spark.read.text(f"{at}/manifest").first().value))
        assert found[0] == found[1]


@pytest.mark.parametrize("kind", KINDS)
def test_freeze(spark, kind):
    index = made(spark, kind, clustered(100, 32, 5, 8))
    index.freeze()
    assert index.frozen
    before = index.search(np.ones(32), 3)
    for change in (lambda: index.add(7777, np.ones(32)), lambda: index.delete(1), index.close):
        with pytest.raises(RuntimeError, match="frozen"):
            change()
    index.unfreeze()
    index.add(7777, np.ones(32))
    assert len(index) == 101 and len(before) == 3


@pytest.mark.parametrize("kind", KINDS)
def test_save_and_load(spark, kind, tmp_path):
    x = clustered(100, 32, 5, 8) * 2
    index = made(spark, kind, x)
    q = frame(spark, x[:3], "query_id")
    want = hits(index.search_batch(q, 5))
    store.save(index, f"file://{tmp_path}/saved")
    first = store.current(spark, f"file://{tmp_path}/saved")
    reader = store.load(spark, f"file://{tmp_path}/saved")
    store.save(index, f"file://{tmp_path}/saved")  # takes the place of the first, which those who read it still have
    assert store.current(spark, f"file://{tmp_path}/saved") != first and hits(reader.search_batch(q, 5)) == want
    store.save(index, f"file://{tmp_path}/saved")
    assert sum(p.name.startswith("v-") for p in (tmp_path / "saved").iterdir()) == 2
    again = store.load(spark, f"file://{tmp_path}/saved")
    assert hits(again.search_batch(q, 5)) == want and again.config() == index.config()
    binary.write_binary(index, f"{tmp_path}/one.file")
    third = binary.read_binary(spark, f"{tmp_path}/one.file")
    # files hold single precision
    assert np.allclose([h[3] for h in hits(third.search_batch(q, 5))], [h[3] for h in want], atol=1e-5)
    raw = bytearray((tmp_path / "one.file").read_bytes())
    raw[60] ^= 1
    (tmp_path / "bad.file").write_bytes(raw)
    with pytest.raises(ValueError, match="CRC"):
        binary.read_binary(spark, f"{tmp_path}/bad.file")


def test_damaged_rows_are_found(spark, tmp_path):
    store.save(made(spark, "scalar", gaussian(20, 16, 1)), f"file://{tmp_path}/s")
    data = f"{store.current(spark, f'file://{tmp_path}/s')}/data"
    spark.read.parquet(data).limit(1).write.mode("append").parquet(data)
    with pytest.raises(ValueError, match="digest"):
        store.load(spark, f"file://{tmp_path}/s")


def test_binary_files_of_other_ages(spark, tmp_path):
    def write(name, body):
        (tmp_path / name).write_bytes(body)
        return f"{tmp_path}/{name}"

    with pytest.raises(ValueError, match="upgrade"):
        binary.read_binary(spark, write("new", binary.SCALAR + struct.pack("<I", 999)))
    with pytest.raises(ValueError, match="magic"):
        binary.read_binary(spark, write("odd", b"ABCD1234"))
    # version 1: no flags, two 3-bit codes to a byte, no trailer
    codes = np.random.default_rng(0).integers(0, 8, (2, 8)).astype(np.uint8)
    old = (codes[:, 0::2] | (codes[:, 1::2] << 3)).astype(np.uint8).tobytes()
    body = binary.SCALAR + struct.pack("<5I", 1, 8, 3, 0, 2) + struct.pack("<I", len(old)) + old + np.ones(2, "<f4").tobytes()
    index = binary.read_binary(spark, write("old", body + b"".join(struct.pack("<H", 1) + i for i in (b"a", b"b"))))
    rows = index.rows.orderBy("id").collect()
    assert [r.id for r in rows] == ["a", "b"]
    assert (kernels.unpack(np.array([list(r.codes) for r in rows], np.uint8), 3, 8) == codes).all()


def test_sealed_files(tmp_path):
    raw = b"".join(binary.sealed([b"ab", b"", b"c"]))
    assert raw == b"abc" + binary.TRAILER + struct.pack("<I", zlib.crc32(b"abc")) and binary.verify_checksum(raw) == b"abc"
    assert b"".join(binary.sealed([])) == binary.TRAILER + bytes(4)
    binary.write_atomic(f"{tmp_path}/f", [b"ab", b"c"])
    assert (tmp_path / "f").read_bytes() == raw and [p.name for p in tmp_path.iterdir()] == ["f"]


def test_guards(spark):
    bad = [
        lambda: ScalarIndex(spark, 8, 5), lambda: ScalarIndex(spark, 8, 2, use_prod=True), lambda: ResidualIndex(spark, 8, 1, 3), lambda: ProductIndex(spark, 10, 3, 4),
        lambda: ProductIndex(spark, 8, 2, 1), lambda: ProductIndex(spark, 8, 0, 4), lambda: ProductIndex(spark, 8, 2, 4, use_rht=True, use_opq=True), lambda: InvertedIndex(spark, 8, 1, 2, 4),
    ]
    for make in bad:
        with pytest.raises(ValueError):
            make()
    index = ProductIndex(spark, 8, 2, 4)
    with pytest.raises(RuntimeError, match="before fit"):
        index.add(1, np.ones(8))
    with pytest.raises(ValueError, match="at least"):
        index.fit(gaussian(3, 8, 1))
    index.fit(gaussian(50, 8, 1))
    with pytest.raises(RuntimeError, match="before"):
        index.fit(gaussian(50, 8, 1))
    with pytest.warns(UserWarning, match="clusters"):
        InvertedIndex(spark, 8, 4, 2, 4).fit(gaussian(50, 8, 1))


def test_training(spark):
    x = clustered(600, 16, 8, 3).astype(float)
    c = training.kmeans(x, 8, 10, 1)
    loss = [((x - c_[kernels.nearest(x, c_)]) ** 2).sum() for c_ in (training.kmeans(x, 8, 1, 1), c)]
    assert loss[1] <= loss[0] + 1e-9 and len(np.unique(kernels.nearest(x, c))) == 8
    same = np.tile(np.eye(5), (20, 1))
    assert np.isfinite(training.kmeans(same, 10, 5, 0)).all()
    cov = training.covariance(frame(spark, x.astype(np.float32)))
    assert np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    r = training.balancing_rotation(cov, 4)
    assert np.allclose(r.T @ r, np.eye(16))
    shares = np.split(np.diag(r.T @ cov @ r), 4)
    assert all((np.diff(s) <= 1e-12).all() for s in shares) and shares[0][0] >= shares[1][0] >= shares[2][0]
    with pytest.raises(ValueError, match="divides"):
        training.balancing_rotation(cov, 5)


def test_rotation_helps_uneven_variance(spark):
    rng = np.random.default_rng(0)
    x = unit(rng.standard_normal((1500, 32)) * np.logspace(0, -2, 32))
    q = unit(rng.standard_normal((20, 32)) * np.logspace(0, -2, 32))
    found = []
    for opq in (False, True):
        index = ProductIndex(spark, 32, 4, 16, use_opq=opq)
        index.fit(x, 8)
        index.add_batch(frame(spark, x))
        found.append(share(spark, index, x, q))
    assert found[1] > found[0]


def test_plans(spark):
    x = clustered(200, 16, 5, 1)
    index = made(spark, "inverted", x)
    q = frame(spark, x[:1], "query_id")
    plan = index.search_batch(q, 3, nprobe=1, filter_ids=frame(spark, x).where("id < 50").select("id"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cluster_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "LeftSemi" in plan and "WindowGroupLimit" in plan
    assert "codes1" in made(spark, "residual", x).search_batch(q, 3)._jdf.queryExecution().toString()


def test_string_ids(spark):
    x = gaussian(6, 8, 1)
    index = ScalarIndex(spark, 8, 4)
    index.add_batch([f"doc-{i}" for i in range(6)], x)
    assert index.search(x[2], 1)[0][0] == "doc-2" and index.delete("doc-2") and len(index) == 5


def test_streams(spark, tmp_path):
    x = gaussian(60, 16, 1)
    frame(spark, x).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index = ScalarIndex(spark, 16, 4)
    index.add_batch(frame(spark, x).where("id < 5"))
    ingest(index, stream, f"{tmp_path}/check").awaitTermination()
    assert sorted(r.id for r in index.rows.select("id").collect()) == list(range(60))
    query = encoded_stream(index, stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


def test_notes(spark, tmp_path):
    (tmp_path / "n" / ".hidden").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text("---\ntitle: x\ntags: [one, 'two', one]\n---\nBody with #three and a/b#no.\r\n\r\nNext paragraph #one\n")
    (tmp_path / "n" / "b.md").write_text("---\ntags:\n  - red\n  - \"blue\"\nother: 1\n---\n" + "\n\n".join(["p" * 900, "q" * 700, "tail"]))
    (tmp_path / "n" / "c.txt").write_text("no note")
    (tmp_path / "n" / ".hidden" / "d.md").write_text("hidden")
    rows = notes.note_chunks(notes.markdown_files(spark, f"{tmp_path}/n")).orderBy("path", "chunk_idx").collect()
    assert [(r.path.rsplit("/", 1)[1], r.chunk_idx) for r in rows] == [("a.md", 0), ("b.md", 0), ("b.md", 1)]
    assert rows[0].tags == ["one", "two", "three"] and rows[1].tags == ["red", "blue"] and rows[0].folder == "n"
    assert rows[0].text == "Body with #three and a/b#no.\n\nNext paragraph #one"
    assert rows[2].text == "q" * 700 + "\n\ntail"

    def embed(texts):
        return [[float(t.count(c)) + 0.1 for c in "pqBx"] for t in texts]

    meta = notes.embedded(spark.createDataFrame(rows), embed)
    notes.write_sidecar(meta.select("id", "path", "chunk_idx", "text", "tags", "folder"), f"{tmp_path}/side")
    side = notes.read_sidecar(spark, f"{tmp_path}/side")
    index = ScalarIndex(spark, 4, 4)
    index.add_batch(meta.select("id", "embedding"))
    got = notes.search_notes(index, side, [9, 0, 0, 0], 3).collect()
    assert got[0].path.endswith("b.md") and got[0].chunk_idx == 0
    tagged = notes.search_notes(index, side, [9, 0, 0, 0], 3, ["three"]).collect()
    assert [r.path.rsplit("/", 1)[1] for r in tagged] == ["a.md"]
    assert notes.status(side).first().asDict() == {"chunks": 3, "notes": 2}


def test_chunks_edges(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n\n ",), ("a\n\nb",), ("x" * 2000,)], "t string")
    assert [r[0] for r in df.select(notes.chunks(F.col("t"))).collect()] == [[], [], [], ["a\n\nb"], ["x" * 2000]]


def letters(texts):
    return [[float(t.lower().count(c)) + 0.1 for c in "pqrstuvw"] for t in texts]


def test_command_line(spark, tmp_path, capsys):
    from tessera.notes import main

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("ppp ppp #work")
    (tmp_path / "n" / "b.md").write_text("qqq qqq #home")
    where = ["--store", f"{tmp_path}/s"]
    embedder = ["--embedder", "tests.test_indexes:letters"]
    assert main(["init", f"{tmp_path}/n", *where, *embedder]) == 0
    assert main(["search", "ppp", *where, *embedder, "-k", "1"]) == 0
    assert main(["search", "ppp", *where, *embedder, "--tag", "home"]) == 0
    assert main(["status", *where]) == 0 and main(["clear", *where]) == 0 and main(["clear", *where]) == 1
    said = capsys.readouterr().out
    assert said.startswith("2 chunks\n1. ") and "a.md#0 [work]\n   ppp ppp #work\n" in said and "b.md#0 [home]" in said
    assert "2 chunks, 2 notes" in said
