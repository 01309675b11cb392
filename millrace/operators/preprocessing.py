"""M1 as stages of ``pyspark.ml``: an estimator that learns medians, quantiles, means and deviations, and its model."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.flow import finite
from millrace.operators.features import preprocessing


class _Columns(HasInputCols, HasOutputCols):
    """What estimator and model share: columns and whether the clipped values are standardised."""

    standardise = Param(Params._dummy(), "standardise", "subtract the mean and divide by the deviation of the clipped training values", TypeConverters.toBoolean)

    def getStandardise(self) -> bool:  # noqa: N802
        return self.getOrDefault(self.standardise)

    def outputs(self) -> list[str]:
        """The output columns; without any the input columns are replaced."""
        names = self.getOutputCols() if self.isDefined(self.outputCols) else self.getInputCols()
        if len(names) != len(self.getInputCols()):
            raise ValueError("inputCols and outputCols differ in length")
        return names


class QuantileClipper(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values with the training median, clips to the training quantiles ``low`` and ``high``, and standardises if asked.

    Quantiles are exact, with linear interpolation. Null, NaN and infinite values are missing; a column without any finite
    training value becomes 0.
    """

    low = Param(Params._dummy(), "low", "the lower quantile", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "the upper quantile", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, low=0.01, high=0.99, standardise=False):  # noqa: N803
        super().__init__()
        self._setDefault(low=0.01, high=0.99, standardise=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setLow(self, value: float) -> QuantileClipper:  # noqa: N802
        return self._set(low=value)

    def setHigh(self, value: float) -> QuantileClipper:  # noqa: N802
        return self._set(high=value)

    def _fit(self, dataset: DataFrame) -> QuantileClipperModel:
        columns = self.getInputCols()
        low, high = self.getOrDefault(self.low), self.getOrDefault(self.high)
        if not 0 <= low <= high <= 1:
            raise ValueError("quantiles must be from 0 to 1 and in order")
        known = preprocessing(dataset, columns, low, high)
        rows = [known.get(c, (0.0, 0.0, 0.0, 0.0, 1.0)) for c in columns]
        model = QuantileClipperModel(**{name: [float(r[i]) for r in rows] for i, name in enumerate(QuantileClipperModel.FIGURES)})
        return self._copyValues(model)


class QuantileClipperModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted figures of each input column, kept as parameters, so they are saved and copied with them."""

    FIGURES = ("medians", "lows", "highs", "means", "deviations")
    medians = Param(Params._dummy(), "medians", "what fills missing values", TypeConverters.toListFloat)
    lows = Param(Params._dummy(), "lows", "lower bounds", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "upper bounds", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means of the clipped training values", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviations of the clipped training values", TypeConverters.toListFloat)

    def __init__(self, **figures: list[float]):
        super().__init__()
        self._setDefault(standardise=False)
        self._set(**figures)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        figures = zip(*(self.getOrDefault(name) for name in self.FIGURES), strict=True)
        out = {}
        for c, name, (median, low, high, mean, deviation) in zip(self.getInputCols(), self.outputs(), figures, strict=True):
            x = F.least(F.greatest(F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(median)), F.lit(low)), F.lit(high))
            out[name] = (x - mean) / (deviation or 1.0) if self.getStandardise() else x
        return dataset.withColumns(out)
