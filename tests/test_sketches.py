import random
from collections import Counter

import numpy as np
from terrane.operators import sketches as K


def test_merged_sketches_keep_their_bounds(spark, tmp_path):
    """Half of the rows have one key; the parts of a key that says nothing are null."""
    r = random.Random(5)
    rows = [("a" if r.random() < 0.9 else "b", r.randrange(6), int(r.expovariate(0.0005)) if r.random() < 0.5 else 3, r.gauss(0, 10)) for _ in range(20_000)]
    rows += [("b", 1, None, None)] * 10
    K.sketch(spark.createDataFrame(rows, "g string, day int, k long, v double"), ["g", "day"], "k", "v").write.parquet(f"{tmp_path}/s")
    parts = spark.read.parquet(f"{tmp_path}/s")
    assert parts.count() == 12
    for x in K.merge(parts, ["g"]).collect():
        own = [row for row in rows if row[0] == x.g]
        keys, values = [row[2] for row in own if row[2] is not None], sorted(row[3] for row in own if row[3] is not None)
        assert x.n == len(own) and abs(x.distinct - len(set(keys))) < 0.03 * len(set(keys))
        for q, v in zip(K.QUANTILES, x.quantiles, strict=True):
            assert abs(np.searchsorted(values, v) / len(values) - q) < 0.02
        exact = Counter(keys)
        assert x.frequent[0]["item"] == 3 and len(x.frequent) == K.TOP
        assert all(abs(f["count"] - exact[f["item"]]) <= 3.5 * len(keys) / K.TRACKED + 1 for f in x.frequent)


def test_nothing_to_merge(spark):
    none = spark.createDataFrame([], "g string, k long, v double")
    assert K.merge(K.sketch(none, ["g"], "k", "v"), ["g"]).collect() == []
