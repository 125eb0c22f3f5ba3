import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import testing
from tessella.operators import dtypes
from tessella.operators.ndarray import NDArray


def test_against_numpy(spark):
    n = np.arange(24).reshape(2, 3, 4)
    a = NDArray.from_function(spark, [2, 3, 4], lambda i, j, k: i * 12 + j * 4 + k)
    same = lambda x, y: (np.asarray(y).shape == x.shape or x.shape == ()) and (x.to_numpy() == y).all()
    assert same(a, n) and same(a.sum(1), n.sum(1)) and same(a.max((0, 2), keepdims=True), n.max((0, 2), keepdims=True))
    assert same(a.reshape(6, 4), n.reshape(6, 4)) and same(a.permute_dims([2, 0, 1]), n.transpose(2, 0, 1))
    assert same(a + a.take(0, 1, 1), n + n[:, :1]) and same((a * 2 - 1).flip(2), (n * 2 - 1)[:, :, ::-1])
    assert same(a.roll(1, 1), np.roll(n, 1, 1)) and same(a.argmax(2), n.argmax(2)) and same(a.take(0, 4, 2, 2), n[:, :, ::2])
    m = a.reshape(6, 4)
    assert same(m @ m.permute_dims([1, 0]), n.reshape(6, 4) @ n.reshape(6, 4).T)
    assert same((a > 10).where(a, -1), np.where(n > 10, n, -1)) and same(m.concat(m, 1), np.concatenate([n.reshape(6, 4)] * 2, 1))
    assert a.sum().to_numpy() == n.sum()
    with pytest.raises(ValueError):
        a.reshape(5, 5)


@pytest.mark.parametrize("a,b,want", [("int64", "uint64", "float64"), ("bool", "int8", "int8"), ("float32", "int32", "float64"), ("int16", "int32", "int32"), ("uint8", "int8", "int16"), ("bigint", "int64", "bigint")])
def test_promotion(a, b, want):
    assert dtypes.result_type(a, b) == dtypes.result_type(b, a) == want
    assert dtypes.of_int(2**63) == "uint64" and dtypes.of_int(2**64) == "bigint" and dtypes.can_cast("int8", "int64") and not dtypes.can_cast("int64", "int8")


def test_asserters(spark):
    a = spark.range(3).withColumn("x", F.lit(1.0))
    testing.assert_frame_equal(a, a.orderBy(F.desc("id")))
    with pytest.raises(AssertionError):
        testing.assert_frame_equal(a, a.limit(2))


def test_cumulative_pad_and_selection_like_numpy(spark):
    x = np.arange(24, dtype=float).reshape(2, 3, 4) % 7
    a = NDArray.from_function(spark, (2, 3, 4), lambda i, j, k: ((i * 12 + j * 4 + k) % 7).cast("double"))
    for axis in (0, 1, 2, -1):
        assert (a.cumulative_sum(axis).to_numpy() == x.cumsum(axis)).all() and (a.cumulative_prod(axis).to_numpy() == x.cumprod(axis)).all()
    blocks = a._cumulative(F.sum, 0.0, lambda own, c: own + c, 2, True, block=2)
    assert (blocks.to_numpy() == np.concatenate([np.zeros((2, 3, 1)), x.cumsum(2)], 2)).all()
    assert (a.pad([(1, 0), (0, 2), (0, 0)], -1.0).to_numpy() == np.pad(x, [(1, 0), (0, 2), (0, 0)], constant_values=-1)).all()
    assert all((p.to_numpy() == x[:, k]).all() for k, p in enumerate(a.unstack(1)))
    asked = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "at long, index long")
    assert (a.take_indices(asked, 2, 3).to_numpy() == x[:, :, [3, 0, 3]]).all()
    assert (a.median(1).to_numpy() == np.median(x, 1)).all() and (a.quantile(0.3, 0, keepdims=True).to_numpy() == pytest.approx(np.quantile(x, 0.3, 0, keepdims=True)))
    kinds, codes = a.unique_inverse()
    values, inverse = np.unique(x, return_inverse=True)
    assert [r.v for r in kinds.orderBy("code").collect()] == values.tolist() and (codes.to_numpy().ravel() == inverse.ravel()).all()


def test_meshgrid_like_numpy(spark):
    from tessella.operators.ndarray import meshgrid

    vectors = [NDArray.arange(spark, 3), NDArray.arange(spark, 2), NDArray.arange(spark, 4)]
    for indexing in ("xy", "ij"):
        for got, want in zip(meshgrid(*vectors, indexing=indexing), np.meshgrid(*map(np.arange, (3, 2, 4)), indexing=indexing), strict=True):
            assert got.shape == want.shape and (got.to_numpy() == want).all()
