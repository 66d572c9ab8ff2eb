"""Detectors as Spark ML estimators: ``fit(windows)`` gives a model, ``transform`` adds the raw score."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from fabsight import constants as K
from fabsight.operators import detectors as D

_FIT = {"pca": D.pca_fit, "var": D.var_fit, "conditional": D.recon_fit, "iforest": D.forest_fit}
_SCORE = {"pca": D.pca_score, "var": D.var_score, "conditional": D.recon_score, "iforest": D.forest_score}


class WindowDetector(Estimator):
    """Detector by name (pca, var, conditional, iforest); options go to its fit function."""

    def __init__(self, kind: str, **options):
        super().__init__()
        if kind not in _FIT:
            raise ValueError(f"unknown detector: {kind}")
        self.kind, self.options = kind, options

    def _fit(self, dataset: DataFrame) -> "WindowDetectorModel":
        return WindowDetectorModel(self.kind, _FIT[self.kind](dataset, **self.options), dataset)


class WindowDetectorModel(Model):
    def __init__(self, kind: str, state, train: DataFrame):
        super().__init__()
        self.kind, self.state, self.train = kind, state, train

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.kind == "iforest":
            return D.forest_score(dataset, self.state, self.train, K.LIMIT_QUANTILE)
        return _SCORE[self.kind](dataset, self.state)
