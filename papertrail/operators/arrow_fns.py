"""Arrow-batched (pandas) functions.

Kept in a module without postponed annotations: pandas UDF type hints
must be real types.  Each function works on whole Arrow batches.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_udf(fn):
    """Wrap ``fn(pd.Series[str]) -> list[list[float]]`` as an Arrow UDF."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in fn(texts)])
    return embed


def pair_score_udf(fn):
    """Wrap ``fn(queries: pd.Series, texts: pd.Series) -> list[float]``
    (e.g. a cross-encoder) as an Arrow UDF."""
    @F.pandas_udf(T.DoubleType())
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in fn(q, t)])
    return score


def text_udf(fn):
    """Wrap ``fn(pd.Series[str]) -> iterable[str]`` (a model's batch
    generate call) as an Arrow UDF."""
    @F.pandas_udf(T.StringType())
    def gen(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else str(x) for x in fn(texts)])
    return gen
