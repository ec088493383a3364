import numpy as np

from narrascope.catalog.queries import trigram_encoder
from narrascope.operators.embedding import embed, feature_hash_embed

ROWS = [(1, "a dark forest"), (2, None), (3, ""), (4, "a dark forest"), (5, "été")]


def test_encoder(spark):
    df = spark.createDataFrame(ROWS, "id long, t string").repartition(3)
    got = {r["id"]: r["embedding"] for r in embed(df, trigram_encoder(16), "t", batch_size=2).collect()}
    assert got[2] is None and all(len(got[i]) == 16 for i in (1, 3, 4, 5))
    assert got[1] == got[4] and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    assert set(got[3]) == {0.0}


def test_feature_hash(spark):
    df = spark.createDataFrame(ROWS, "id long, t string").repartition(3)
    got = {r["id"]: r["embedding"] for r in feature_hash_embed(df, "t", 16).collect()}
    assert set(got) == {1, 3, 4, 5} and all(len(v) == 16 for v in got.values())
    assert got[1] == got[4] and set(got[3]) == {0.0}
