"""Text to vector: a user-supplied encoder, or signed hashing of tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions import text as tx

BATCH_SIZE = 64


def embed(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    text_col: str,
    out: str = "embedding",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Encode every text; null text gives a null vector.

    `make_predict_fn` loads the model once per Python worker and returns a function from an array of
    texts to a matrix. Write the result (`materialize`) before fitting on it: encoding is the
    expensive step and should run once.
    """
    encode = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, F.when(F.col(text_col).isNotNull(), encode(text)))


def _hashed_sums(codes: Column, dim: int) -> Column:
    """Signed sums per slot with unit length, one vectorised count per Arrow batch."""

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        n = len(lists)
        flat = np.asarray(lists.flatten(), dtype=np.int64)
        row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
        weights = np.where((flat & 15) < 8, 1.0, -1.0)
        slots = row * dim + (flat >> 4) % dim
        sums = np.bincount(slots, weights, minlength=n * dim).reshape(n, dim)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        unit = sums / np.where(norm == 0, 1.0, norm)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(unit.ravel())
        )

    return run.asNondeterministic()(codes)  # evaluated once, see `vectors.project`


def feature_hash_embed(
    df: DataFrame, text_col: str, dim: int = 64, out: str = "embedding"
) -> DataFrame:
    """`df` with signed hashing of tokens, unit length; lexical, not semantic. No shuffle.

    The hash of a token gives its slot (first six hex digits) and its sign (seventh). The tokens are
    hashed in the JVM; only the codes go to the vectorised count.
    """
    rows = df.where(F.col(text_col).isNotNull())
    codes = F.transform(
        tx.tokens(text_col),
        lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"),
    )
    return rows.withColumn(out, _hashed_sums(codes, dim))
