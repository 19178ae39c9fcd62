"""Random Fourier features: an approximation of the RBF kernel (Rahimi and Recht, 2007)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Map x to sqrt(2/D) cos(Wx + b), so that inner products come near exp(-gamma |x - y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    count = Param(Params._dummy(), "count", "number of features", TypeConverters.toInt)

    def __init__(self, *, inputCol: str = "features", outputCol: str = "fourier", gamma: float = 0.1,
                 count: int = 256, seed: int = 17):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, count=count, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, count, seed = self.getOrDefault("gamma"), self.getOrDefault("count"), self.getSeed()

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if rows.empty:
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            draw = np.random.default_rng(seed)
            w = draw.normal(0.0, np.sqrt(2 * gamma), size=(x.shape[1], count))
            b = draw.uniform(0.0, 2 * np.pi, size=count)
            return pd.Series(list(np.sqrt(2.0 / count) * np.cos(x @ w + b)))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class MarginProbabilities(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Softmax of the margins of one machine per class, so that the likeliest class is the predicted one."""

    def __init__(self, *, inputCol: str = "margins", outputCol: str = "probability"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        margins = vector_to_array(self.getInputCol())
        shifted = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.transform(shifted, lambda x: x / total)))
