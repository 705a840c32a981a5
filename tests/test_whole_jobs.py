"""Queries answer for every row of their table, whatever its id."""

import os

import numpy as np
import pytest

from tallyframe.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_vector_has_its_nearest(spark):
    """As brute force: of each vector the nearest of all others."""
    rows = sorted(map(tuple, spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()))
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    cosine = v @ v.T
    np.fill_diagonal(cosine, -1)
    want = {rows[k][0]: (rows[j][0], rows[j][2], pytest.approx(cosine[k, j], abs=1e-6)) for k, j in enumerate(cosine.argmax(axis=1)) if cosine[k, j] >= 0.3}
    got = {r["vec_id"]: (r["ref_name"], r["label"], r["similarity"]) for r in QUERIES["nearest_category"](spark, DATA).collect()}
    assert got == want and len(got) > len(rows) / 2
    assert "%" not in ORACLES["nearest_category"]
