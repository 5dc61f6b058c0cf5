"""Unsupervised learning on customer features, with ``pyspark.ml``.

* ``zscore_features``: log1p, then z-scores with the *population* standard
  deviation (zero variance -> 0). Means and deviations come from one
  aggregate used as a scalar subquery.
* k-means: ``pyspark.ml.clustering.KMeans`` with k-means|| seeding; the best
  of ``n_init`` seeded fits by within-cluster sum of squares. Independent
  fits are submitted together.
* ``silhouette``: mean silhouette of *all* rows with squared Euclidean
  distances (``ClusteringEvaluator``), which follows from each cluster's
  count, sum and squared norms in time linear in the rows. Euclidean
  distances would need all pairs.
* ``add_pca``: ``pyspark.ml.feature.PCA``; signs are fixed so that the
  largest loading of each component is positive.
* Cluster names are canonical: ``Cluster 1`` has the highest mean Monetary.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.functions.numeric import from_micros, half_even, micros
from retail_insight.session import materialize

RFMT_FEATURES = ("Recency", "Frequency", "Monetary", "Tenure")
PCA_COLUMNS = ("PCA_1", "PCA_2", "PCA_3")
# Fixed values of the clustering set-up.
DEFAULT_SEED = 42
MAX_ITER = 300
TOL = 1e-4
# Seeded fits for each k. k-means|| draws several candidates for each center,
# so few restarts do what many single draws would.
SWEEP_N_INIT = 2
FINAL_N_INIT = 3
_FITS_AT_ONCE = 4
_X = "__x"


# ---------------------------------------------------------------- features

def zscore_features(df: DataFrame, cols: Sequence[str] = RFMT_FEATURES, log1p: bool = True,
                    prefix: str = "z_") -> DataFrame:
    """Add ``prefix + col``: (log1p(x) - mean) / population std; 0 when the
    feature has no variance."""
    xs = {c: (F.log1p(F.col(c).cast("double")) if log1p else F.col(c).cast("double")) for c in cols}
    stats = df.select(F.struct(*(
        [F.avg(x).alias(f"mu_{i}") for i, x in enumerate(xs.values())]
        + [F.stddev_pop(x).alias(f"sd_{i}") for i, x in enumerate(xs.values())]
    )).alias("s")).scalar()
    out = {}
    for i, (c, x) in enumerate(xs.items()):
        mu, sd = stats.getField(f"mu_{i}"), stats.getField(f"sd_{i}")
        out[prefix + c] = F.coalesce(F.try_divide(x - mu, F.when(sd != 0, sd)), F.lit(0.0))
    return df.withColumns(out)


# ---------------------------------------------------------------- k-means

def with_vector(df: DataFrame, cols: Sequence[str], out: str = _X) -> DataFrame:
    """Add the numeric ``cols`` as one vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def best_kmeans(points: DataFrame, ks: Sequence[int], n_init: int, seed: int = DEFAULT_SEED,
                features_col: str = _X) -> dict[int, KMeansModel]:
    """For each k the fit with the least within-cluster sum of squares of
    ``n_init`` seeded ones (the first on ties). ``points`` should be
    materialised: every fit reads it."""
    def fit(job: tuple[int, int]) -> tuple[int, float, KMeansModel]:
        k, i = job
        model = KMeans(k=k, seed=seed + i, maxIter=MAX_ITER, tol=TOL, featuresCol=features_col).fit(points)
        return k, model.summary.trainingCost, model

    with ThreadPoolExecutor(_FITS_AT_ONCE) as pool:
        fits = list(pool.map(fit, [(k, i) for k in ks for i in range(n_init)]))
    return {k: min((f for f in fits if f[0] == k), key=lambda f: f[1])[2] for k in ks}


def label(points: DataFrame, model: KMeansModel, out: str) -> DataFrame:
    """Add the number of each row's nearest center."""
    return model.copy({model.predictionCol: out}).transform(points)


def canonical_cluster_names(pred: DataFrame, prediction_col: str = "prediction",
                            out_col: str = "ML_Cluster", order_col: str = "Monetary") -> DataFrame:
    """Rename model cluster ids to ``Cluster 1..k`` by descending mean of
    ``order_col`` (added up exactly; ties: larger cluster, then model id)."""
    stats = pred.groupBy(prediction_col).agg(
        (F.sum(micros(order_col)).cast("double") / F.count(F.lit(1))).alias("__m"), F.count(F.lit(1)).alias("__n"))
    # One row per cluster (k rows): a window over them is tiny.
    order = Window.orderBy(F.col("__m").desc(), F.col("__n").desc(), F.col(prediction_col).asc())
    names = stats.select(prediction_col, F.concat(F.lit("Cluster "), F.row_number().over(order)
                                                  .cast("string")).alias(out_col))
    return pred.join(F.broadcast(names), prediction_col, "inner")


def cluster_order(pred: DataFrame, prediction_col: str = "prediction", order_col: str = "Monetary") -> dict[int, int]:
    """The place (from 1) of each cluster number in canonical order."""
    rows = pred.groupBy(prediction_col).agg((F.sum(micros(order_col)).cast("double") / F.count(F.lit(1))).alias("m"),
                                            F.count(F.lit(1)).alias("n")).collect()   # one row for each cluster
    ranked = sorted(rows, key=lambda r: (-r["m"], -r["n"], r[prediction_col]))
    return {r[prediction_col]: i + 1 for i, r in enumerate(ranked)}


def cluster_profile(clustered: DataFrame, cluster_col: str = "ML_Cluster") -> DataFrame:
    """Per cluster: count, revenue, mean R/F/M/T/AOV, customer and revenue
    shares (1 dp)."""
    per = clustered.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("CustomerCount"),
        F.sum(micros("Monetary")).alias("__rev"),
        F.sum("Recency").alias("__rec"), F.sum("Frequency").alias("__freq"),
        F.sum("Tenure").alias("__ten"), F.sum(micros("AvgOrderValue")).alias("__aov"))
    n = F.col("CustomerCount")
    rev = from_micros("__rev")
    everything = Window.partitionBy()   # over the k cluster rows only
    return per.select(
        cluster_col, n.alias("CustomerCount"), rev.alias("TotalRevenue"),
        half_even(F.col("__rec") / n, 1).alias("MeanRecency"),
        half_even(F.col("__freq") / n, 1).alias("MeanFrequency"),
        half_even(rev / n, 2).alias("MeanMonetary"),
        half_even(F.col("__ten") / n, 1).alias("MeanTenure"),
        half_even(from_micros("__aov") / n, 2).alias("MeanAOV"),
        half_even(n / F.greatest(F.sum(n).over(everything), F.lit(1)) * F.lit(100.0), 1).alias("CustomerPct"),
        half_even(rev / F.greatest(F.sum(rev).over(everything), F.lit(1.0)) * F.lit(100.0), 1)
        .alias("RevenuePct"),
    ).orderBy(cluster_col)


# ---------------------------------------------------------------- silhouette

def silhouette(df: DataFrame, label_col: str, features_col: str = _X) -> float | None:
    """Mean silhouette of all rows, squared Euclidean; a row that is its
    cluster's only one scores 0. None with fewer than two labels."""
    if df.select(label_col).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(predictionCol=label_col, featuresCol=features_col,
                               distanceMeasure="squaredEuclidean").evaluate(df)


def embedding_silhouette(df: DataFrame, array_col: str, label_col: str) -> DataFrame:
    """One row (key, silhouette) for an array column and its labels."""
    points = df.select(array_to_vector(F.col(array_col).cast("array<double>")).alias(_X), F.col(label_col).cast("double").alias("__l"))
    return df.sparkSession.createDataFrame([(label_col, silhouette(points, "__l"))], "key string, silhouette double")


# ---------------------------------------------------------------- sweep

def evaluate_kmeans_candidates(points: DataFrame, feature_cols: Sequence[str], id_col: str = "CustomerID",
                               min_k: int = 2, max_k: int = 7, n_init: int = SWEEP_N_INIT,
                               seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows (k, Inertia 2 dp, Silhouette_Score 4 dp) for k in [min_k, max_k],
    fitted and scored on all rows."""
    base = materialize(with_vector(points.select(id_col, *feature_cols), feature_cols).select(_X))
    ks = list(range(min_k, max_k + 1))
    best = best_kmeans(base, ks, n_init, seed)
    rows = [(k, round(best[k].summary.trainingCost, 2), silhouette(label(base, best[k], "__k"), "__k")) for k in ks]
    found = points.sparkSession.createDataFrame(rows, "k int, Inertia double, s double")
    return found.select("k", "Inertia", half_even("s", 4).alias("Silhouette_Score"))


def optimal_k(evaluation: DataFrame) -> int:
    """k with the highest rounded silhouette, smallest k on ties (reads the
    few evaluation rows)."""
    row = evaluation.orderBy(F.col("Silhouette_Score").desc_nulls_last(), F.col("k").asc()).first()
    return int(row["k"])


def perform_kmeans_clustering(customers: DataFrame, n_clusters: int = 4, seed: int = DEFAULT_SEED,
                              n_init: int = FINAL_N_INIT, feature_cols: Sequence[str] = RFMT_FEATURES
                              ) -> tuple[DataFrame, KMeansModel, DataFrame]:
    """Cluster on z-scored log1p features; returns (customers + ML_Cluster,
    best model, cluster profile)."""
    z = materialize(zscore_features(customers, feature_cols))
    named, model = cluster_zscored(z, n_clusters, seed, n_init, feature_cols)
    named = named.drop(*[f"z_{c}" for c in feature_cols])
    return named, model, cluster_profile(named)


def cluster_zscored(z: DataFrame, n_clusters: int, seed: int = DEFAULT_SEED, n_init: int = FINAL_N_INIT,
                    feature_cols: Sequence[str] = RFMT_FEATURES) -> tuple[DataFrame, KMeansModel]:
    """Fit on existing, materialised ``z_`` columns and add canonical
    ``ML_Cluster``."""
    points = with_vector(z, [f"z_{c}" for c in feature_cols])
    model = best_kmeans(points.select(_X), [n_clusters], n_init, seed)[n_clusters]
    return canonical_cluster_names(label(points, model, "__pred"), "__pred").drop("__pred", _X), model


def cluster_check(z: DataFrame, model: KMeansModel, feature_cols: Sequence[str] = RFMT_FEATURES) -> DataFrame:
    """One row (Customers, Misplaced, InertiaOff): how many rows are not at
    their nearest center, and 1 if the distances do not add up to the model's
    sum of squares (to 1 in a million)."""
    labelled = label(with_vector(z, [f"z_{c}" for c in feature_cols]), model, "__pred")
    centers = F.lit([[float(v) for v in c] for c in model.clusterCenters()])
    x = vector_to_array(F.col(_X))
    away = F.transform(centers, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    seen = labelled.select(F.element_at(away, F.col("__pred") + 1).alias("d"), F.array_min(away).alias("least"))
    cost = F.lit(float(model.summary.trainingCost))
    return seen.agg(F.count(F.lit(1)).alias("Customers"), F.count_if(F.col("d") > F.col("least") + 1e-9).alias("Misplaced"),
                    (F.abs(F.sum("d") - cost) > cost * 1e-6).cast("int").alias("InertiaOff"))


# ---------------------------------------------------------------- PCA

def add_pca(z: DataFrame, feature_cols: Sequence[str] = RFMT_FEATURES, n_components: int = 3
            ) -> tuple[DataFrame, list[float]]:
    """Add PCA_1.. (4 dp) from existing ``z_`` columns, which are centred;
    also return the explained-variance ratios in percent (2 dp)."""
    points = with_vector(z, [f"z_{c}" for c in feature_cols])
    model = PCA(k=n_components, inputCol=_X, outputCol="__pc").fit(points)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(n_components)]
    at = vector_to_array(F.col("__pc"))
    out = model.transform(points).withColumns(
        {f"PCA_{j + 1}": half_even(at[j] * F.lit(signs[j]), 4) for j in range(n_components)})
    return out.drop(_X, "__pc"), [round(float(v) * 100.0, 2) for v in model.explainedVariance.toArray()]


def pca_3d(customers: DataFrame, feature_cols: Sequence[str] = RFMT_FEATURES, n_components: int = 3
           ) -> tuple[DataFrame, list[float]]:
    """add_pca on z-scored log1p features, which are dropped again."""
    out, evr = add_pca(materialize(zscore_features(customers, feature_cols)), feature_cols, n_components)
    return out.drop(*[f"z_{c}" for c in feature_cols]), evr
