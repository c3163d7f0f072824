"""Links at every number of blocks of the lattice."""

import numpy as np
import pytest

from factspan.llm import lattice


@pytest.mark.parametrize("blocks, cells", [(3, 150), (4, 9), (5, 5), (6, 3.6)])
def test_pairs_near_the_threshold_are_found_at_every_number_of_blocks(spark, monkeypatch, blocks, cells):
    monkeypatch.setattr(lattice, "CELLS_PER_BLOCK", cells)
    rng, pairs, cosine = np.random.default_rng(2), 1000, 0.951
    assert max(3, np.ceil(np.log(2 * pairs) / np.log(cells))) == blocks
    u, v = rng.normal(size=(2, pairs, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (v * u).sum(1, keepdims=True) * u
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, cosine * u + np.sqrt(1 - cosine**2) * v]))]
    found = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert found.agg({"n_links": "sum"}).first()[0] >= 0.98 * 2 * pairs
