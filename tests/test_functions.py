"""Numeric operators: expressions against kernels, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codebooks, kernels
from tessera.functions import exprs as X


def unit_gaussian(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize(("dim", "padded"), [(0, 1), (1, 1), (2, 2), (3, 4), (64, 64), (65, 128), (384, 512)])
def test_padded_dim(dim, padded):
    assert codebooks.padded_dim(dim) == padded


def test_codebooks_are_mirrored_and_bits_are_checked():
    for bits in (2, 3, 4):
        c, b = codebooks.get_codebook(bits)
        assert len(c) == 2**bits and len(b) == 2**bits - 1
        assert np.allclose(c, -c[::-1]) and (np.diff(c) > 0).all() and (np.diff(b) > 0).all()
    with pytest.raises(ValueError, match="bits"):
        codebooks.get_codebook(5)


@settings(max_examples=25, deadline=None)
@given(st.sampled_from([2, 4, 8, 32, 64]), st.integers(0, 1000))
def test_rotation_keeps_lengths_and_has_an_inverse(d, seed):
    x = np.random.default_rng(seed).standard_normal((3, d))
    y = kernels.rht(x, seed)
    assert np.allclose((y * y).sum(1), (x * x).sum(1))
    dense = kernels.rht(np.eye(d), seed)
    assert np.allclose(dense @ dense.T, np.eye(d))
    assert np.allclose(y @ dense.T, x)


@settings(max_examples=25, deadline=None)
@given(st.sampled_from([2, 3, 4]), st.integers(1, 40), st.sampled_from([8, 16, 64]), st.integers(0, 1000))
def test_packing_round_trip(bits, n, d, seed):
    codes = np.random.default_rng(seed).integers(0, 2**bits, (n, d)).astype(np.uint8)
    packed = kernels.pack(codes, bits)
    assert packed.shape == (n, d * bits // 8)
    assert (kernels.unpack(packed, bits, d) == codes).all()
    assert (kernels.expanded(packed, bits, d) == codebooks.half_centroids(bits)[codes]).all()
    odd = codes[:, :3]  # bits that don't fill bytes stay one code a byte
    assert (kernels.expanded(kernels.pack(odd, bits), bits, 3) == codebooks.half_centroids(bits)[odd]).all()


def test_three_bit_layout():
    # eight codes are a little-endian number of 24 bits
    codes = np.array([[1, 2, 3, 4, 5, 6, 7, 0]], np.uint8)
    number = sum(int(c) << (3 * i) for i, c in enumerate(codes[0]))
    assert kernels.pack(codes, 3)[0].tolist() == list(number.to_bytes(3, "little"))


def test_zero_goes_to_the_lower_bin():
    assert kernels.encode(np.array([[0.0]]), 2)[0, 0] == 1


def test_expressions_equal_kernels(spark):
    x = unit_gaussian(20, 24, 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, embedding array<float>")
    y = X.scaled_rotation(X.unit(X.doubles(F.col("embedding")), X.norm(X.doubles(F.col("embedding")))), 24, 5)
    rows = df.select("id", y.alias("y")).withColumn("c", X.encode(F.col("y"), 3)).withColumn("p", X.pack(F.col("c"), 3))
    rows = rows.withColumn("r", X.residual_encode(F.col("y"), F.col("c"), 3, 4)).withColumn("u", X.unpack(F.col("p"), 3)).orderBy("id").collect()
    want = kernels.rht(kernels.pad(kernels.units(x.astype(float))), 5) * np.sqrt(32)
    codes = kernels.encode(want, 3)
    assert np.allclose([r.y for r in rows], want)
    assert [r.c for r in rows] == codes.tolist() == [r.u for r in rows]
    assert [r.p for r in rows] == kernels.pack(codes, 3).tolist()
    assert [r.r for r in rows] == kernels.residual_encode(want, codes, 3, 4).tolist()


def test_lookup_score(spark):
    df = spark.createDataFrame([([1, 0, 2], [float(i) for i in range(9)])], "c array<int>, t array<double>")
    assert df.select(X.lookup_score(F.col("c"), F.col("t"), 3)).first()[0] == 1 + 3 + 8


def test_stored_norm_of_tiny_vectors(spark):
    df = spark.createDataFrame([([0.0, 1e-12],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(X.stored_norm(F.col("v"))).collect()] == [0.0, 5.0]
    assert kernels.norms(np.array([[0.0, 1e-12], [3.0, 4.0]])).tolist() == [0.0, 5.0]


def test_nearest_takes_the_lowest_of_equals(spark):
    c = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert kernels.nearest(np.array([[1.0, 0.0]]), c).tolist() == [0]
    assert spark.createDataFrame([([1.0, 0.0],)], "v array<double>").select(X.nearest(F.col("v"), c)).first()[0] == 0


def test_snippet(spark):
    assert spark.createDataFrame([("  a \n\t b  " + "x" * 300,)], "t string").select(X.snippet(F.col("t"))).first()[0] == ("a b " + "x" * 300)[:220]


def test_sql_functions(spark):
    from tessera.functions import sql

    sql.register(spark)
    spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").createOrReplaceTempView("v")
    rows = spark.sql("SELECT vec_dot(a, b), vec_norm(a), vec_distance2(a, b), vec_cosine(a, b) FROM v").collect()
    assert [tuple(r) for r in rows] == [(24.0, 5.0, 2.0, 0.96), (0.0, 0.0, 1.0, None)]
