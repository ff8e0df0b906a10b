"""Vector arithmetic on ARRAY columns and the vectorised template scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _c

EPSILON = 1e-6


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def mean_centre(v) -> Column:
    total = F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.transform(_c(v), lambda x: x.cast("double") - total / F.size(_c(v)))


def unit(v) -> Column:
    """v / (|v| + 1e-6)."""
    return F.transform(_c(v), lambda x: x.cast("double") / (l2_norm(v) + EPSILON))


def cyclic_roll(v, shift: int) -> Column:
    """Rotate right by ``shift`` places."""
    n = F.size(_c(v))
    k = (F.lit(shift) % n + n) % n
    return F.concat(F.slice(_c(v), n - k + 1, k), F.slice(_c(v), F.lit(1), n - k))


def template_scorer(matrix: np.ndarray, labels: list[str], first_index: int = 0):
    """pandas UDF: best template per vector as struct(score, idx, label); first wins ties.

    ``matrix`` holds unit rows and is shipped with the task, so its size must be bounded by
    the caller (see ``operators.motif.template_match``).
    """
    unit_rows = matrix.astype(np.float64)

    @F.pandas_udf("struct<score double, idx bigint, label string>")
    def score(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, unit_rows.shape[1]))
        scores = x @ unit_rows.T
        best = scores.argmax(axis=1) if len(x) else np.empty(0, dtype=np.int64)
        return pd.DataFrame(
            {
                "score": scores[np.arange(len(x)), best],
                "idx": best.astype(np.int64) + first_index,
                "label": [labels[i] for i in best],
            }
        )

    return score
