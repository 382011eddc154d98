"""The queries over whole tables, on a scale where a prefix of the rows is less than all of them."""

import math

import pytest
from oracle import connect, same_rows

from cellframe.plans import queries as Q
from cellframe.plans import tables as T

SF = "/root/testdata/sf0.01"
CUT = ("u14_not", "b1_add_mixed", "p10_eq_scalar", "p11_ne_scalar", "p12_gt_scalar", "p13_ge_scalar", "p14_lt_scalar", "p15_le_scalar", "r02_product_all", "g12_into_dense", "m1_matmul_tiles", "f3_fft2", "f4_ifft2", "s06_copy_from_values", "s11_read_blocks")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CUT)
def test_every_row_is_computed(spark, con, name):
    name = {"m1_matmul_tiles": "m1_matmul_tiles_rows"}.get(name, name)
    df = Q.QUERIES[name](spark, SF).cache()
    n = T.embeddings(spark, SF).shape[0]
    wanted = {"r02": 1, "m1": n * n, "f3": n * 64, "f4": n * 64}.get(name.split("_")[0], math.prod(T.quantity(spark, SF).shape))
    assert df.count() == wanted
    assert same_rows(df, con, Q.ORACLE[name]) is None
    df.unpersist()
