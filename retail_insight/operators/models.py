"""The customer model as a saved ``pyspark.ml`` pipeline.

:func:`fit_customer_model` learns z-scores, clusters with their names, and
principal components from one customer table. The result is an ordinary
``PipelineModel``: ``model.write().overwrite().save(path)``,
``PipelineModel.load(path)``, ``model.transform(new_customers)``. Everything
that depends on the data (means, deviations, centers, the order of clusters,
loadings and their signs) is fixed when it is fitted, so new customers are
placed among the old ones, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.numeric import half_even
from retail_insight.operators.clustering import DEFAULT_SEED, FINAL_N_INIT, RFMT_FEATURES, best_kmeans, cluster_order
from retail_insight.session import materialize

_X, _PC, _PRED = "__x", "__pc", "__pred"


class _Saved(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters hold all that it knows."""

    def _keep(self, **values):
        return self._set(**values)

    def of(self, param: str):
        return self.getOrDefault(param)


class ZScores(_Saved):
    """``z_<column>``: (log1p(x) - mean) / deviation with fixed figures, 0
    where the deviation is 0."""

    columns = Param(Params._dummy(), "columns", "columns to scale", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "mean of log1p of each", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of log1p of each", TypeConverters.toListFloat)

    def fit_to(self, df: DataFrame, columns: Sequence[str]) -> ZScores:
        xs = [F.log1p(F.col(c).cast("double")) for c in columns]
        row = df.agg(*[F.avg(x) for x in xs], *[F.stddev_pop(x) for x in xs]).first()
        n = len(xs)
        return self._keep(columns=list(columns), means=[float(v or 0.0) for v in row[:n]], deviations=[float(v or 0.0) for v in row[n:]])

    def _transform(self, df: DataFrame) -> DataFrame:
        figures = zip(self.of("columns"), self.of("means"), self.of("deviations"), strict=True)
        return df.withColumns({f"z_{c}": F.coalesce((F.log1p(F.col(c).cast("double")) - F.lit(mu)) / F.lit(sd), F.lit(0.0)) if sd else F.lit(0.0)
                               for c, mu, sd in figures})


class ClusterNames(_Saved):
    """``ML_Cluster``: the name that each cluster number was given."""

    names = Param(Params._dummy(), "names", "name of each cluster number", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.of("names")])
        return df.withColumn("ML_Cluster", F.element_at(names, F.col(_PRED) + 1)).drop(_PRED)


class Components(_Saved):
    """``PCA_1``.. at 4 decimals, with fixed signs; drops the vectors and
    z-scores that led there."""

    signs = Param(Params._dummy(), "signs", "1 or -1 for each component", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        at = vector_to_array(F.col(_PC))
        out = df.withColumns({f"PCA_{j + 1}": half_even(at[j] * F.lit(s), 4) for j, s in enumerate(self.of("signs"))})
        return out.drop(_X, _PC, *[c for c in df.columns if c.startswith("z_")])


def fit_customer_model(customers: DataFrame, n_clusters: int = 4, n_components: int = 3, seed: int = DEFAULT_SEED,
                       n_init: int = FINAL_N_INIT, feature_cols: Sequence[str] = RFMT_FEATURES) -> PipelineModel:
    """Fit on a customer table with ``feature_cols`` and Monetary. The model
    adds ML_Cluster and PCA_1.. to any table that has ``feature_cols``."""
    scale = ZScores().fit_to(customers, feature_cols)
    gather = VectorAssembler(inputCols=[f"z_{c}" for c in feature_cols], outputCol=_X)
    points = materialize(gather.transform(scale.transform(customers)).select("Monetary", _X))
    means = best_kmeans(points.select(_X), [n_clusters], n_init, seed)[n_clusters]
    means.setPredictionCol(_PRED)
    order = cluster_order(means.transform(points), _PRED)
    names = ClusterNames()._keep(names=[f"Cluster {order[k]}" if k in order else "" for k in range(len(means.clusterCenters()))])
    turn = PCA(k=n_components, inputCol=_X, outputCol=_PC).fit(points)
    loadings = turn.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(n_components)]
    return PipelineModel([scale, gather, means, names, turn, Components()._keep(signs=signs)])
