"""The fitted preparation of accounts: an Estimator that learns fills and scale, and a Model that applies them row by row.

The model holds medians, modes, means and deviations as parameters, so it is saved and loaded with the trees
in one ``PipelineModel``, and scoring fits nothing: a row alone gets what it gets in the full table.
"""

from __future__ import annotations

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as FE
from . import quality as Q
from .sampling import hash_split

VAL_PER_MILLE = 125


def shaped(accounts: DataFrame) -> DataFrame:
    """Everything before the fitted steps."""
    return Q.impute_zero(Q.clip_pay(Q.recode_categories(Q.trim_columns(accounts))))


def filled(df: DataFrame, medians: dict, modes: dict) -> DataFrame:
    """M3, M4, then F1 and F2."""
    return FE.engineer(Q.fill_values(Q.fill_values(df, medians), modes, keep_type=True))


class AccountPreparationModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Cleaning, fills, derived features and z-scale with saved values. A feature without a value after that (zero credit
    limit, zero deviation) becomes 0, the mean; other columns pass through."""

    medians = Param(Params._dummy(), "medians", "fill by column")
    modes = Param(Params._dummy(), "modes", "fill by status column")
    means = Param(Params._dummy(), "means", "mean by scaled column")
    deviations = Param(Params._dummy(), "deviations", "sample deviation by scaled column")

    @keyword_only
    def __init__(self, *, medians=None, modes=None, means=None, deviations=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def values(self) -> dict:
        """Everything that was fitted, by kind and column."""
        return {p.name: self.getOrDefault(p) for p in (self.medians, self.modes, self.means, self.deviations)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = self.values()
        out = FE.zscore_transform(filled(shaped(dataset), v["medians"], v["modes"]), {c: (m, v["deviations"][c]) for c, m in v["means"].items()})
        return out.fillna(0.0, subset=[c for c in v["means"] if c in out.columns])


class AccountPreparation(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits medians and modes on all rows and the scale on the rows of the split ``fitOn`` ('all' for every row)."""

    fitOn = Param(Params._dummy(), "fitOn", "split that the scale is fitted on")

    @keyword_only
    def __init__(self, *, fitOn="train"):
        super().__init__()
        self._setDefault(fitOn="train")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> AccountPreparationModel:
        base = shaped(dataset).persist(StorageLevel.MEMORY_AND_DISK)  # read by several scans
        try:
            medians, modes = Q.fit_median(base), Q.fit_mode(base)
            rows, on = filled(base, medians, modes), self.getOrDefault(self.fitOn)
            if on != "all":
                rows = hash_split(rows, "id", cuts=((VAL_PER_MILLE, "val"),)).where(F.col("split") == on)
            scale = FE.zscore_params(FE.zscore_fit(rows))
        finally:
            base.unpersist()
        return AccountPreparationModel(medians=medians, modes=modes, means={c: m for c, (m, _) in scale.items()}, deviations={c: s for c, (_, s) in scale.items()})
