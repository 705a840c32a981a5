"""Keys that one set alone has are dropped before they are shuffled."""

import numpy as np
import pytest

from tallyframe.llm import jaccard
from tallyframe.llm.common import splitmix


@pytest.mark.parametrize("bits", [26, 6])
def test_likely(spark, monkeypatch, bits):
    """All shared keys of a part stay, whatever the bitmap's size; of the others few, if it has room."""
    monkeypatch.setattr(jaccard, "BITS", bits)
    own = splitmix(np.arange(1, 4001, dtype=np.uint64)).view(np.int64).tolist()
    rows = [(i, 2, own[i * 40 : i * 40 + 40] + own[:5]) for i in range(100)] + [(100, 0, [])]
    table = spark.createDataFrame(rows, "id long, least long, blocks array<long>").repartition(3)
    wanted = {k for i, _, b in rows for k in b if i and k in own[:5]}
    kept = []
    for part in range(jaccard.PARTS):
        mine = [(k,) for k in own[:5] if k % jaccard.PARTS == part]
        got = jaccard.likely(table, part, spark.createDataFrame(mine, "key long")).collect()
        assert all(r["key"] % jaccard.PARTS == part and r["key"] in rows[r["id"]][2] and r["least"] == 2 for r in got)
        kept += [(r["id"], r["key"]) for r in got]
    assert {(i, k) for i in range(100) for k in wanted} <= set(kept)
    assert bits == 6 or len(kept) < 2 * 505
