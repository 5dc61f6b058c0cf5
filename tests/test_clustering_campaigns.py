import numpy as np
from pyspark.sql import functions as F

from retail_insight.operators import campaigns as camp
from retail_insight.operators import clustering as ml


def _brute_silhouette(x, labels):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in np.unique(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_of_all_rows_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (900, 3)), rng.normal(4, 1, (600, 3)), rng.normal([0, 6, 0], 1, (1, 3))])
    labels = np.array([0] * 900 + [1] * 600 + [2])         # one singleton cluster
    df = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(len(x))],
                               "id long, p array<double>, l int")
    got = ml.embedding_silhouette(df, "p", "l").first().silhouette
    assert abs(got - _brute_silhouette(x, labels)) < 1e-9
    one = spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(5)], "id long, p array<double>, l int")
    assert ml.embedding_silhouette(one, "p", "l").first().silhouette is None


def test_kmeans_recovers_separated_blobs(spark):
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.vstack([rng.normal(c, 0.5, (50, 2)) for c in centers])
    df = spark.createDataFrame([(f"c{i}", *map(float, x[i])) for i in range(len(x))], "CustomerID string, a double, b double")
    best = ml.best_kmeans(ml.with_vector(df, ["a", "b"]), [2, 3], 2)
    found = np.array(best[3].clusterCenters())
    nearest = np.sqrt(((centers[:, None, :] - found[None]) ** 2).sum(axis=2)).min(axis=1)
    assert nearest.max() < 0.3
    d2 = ((x[:, None, :] - found[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert abs(best[3].summary.trainingCost - d2) < 1e-6
    assert best[2].summary.trainingCost > best[3].summary.trainingCost


def test_zscore_population_sigma_and_zero_variance(spark):
    rows = [(str(i), i, 1, float(i * i), 7) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency long, Monetary double, Tenure int")
    z = ml.zscore_features(df).orderBy("CustomerID").collect()
    r = np.log1p(np.arange(1, 6, dtype=float))
    want = (r - r.mean()) / r.std(ddof=0)
    assert np.allclose([row.z_Recency for row in z], want, atol=1e-12)
    assert all(row.z_Frequency == 0.0 and row.z_Tenure == 0.0 for row in z)


def test_pca_matches_numpy_eigen(spark):
    rng = np.random.default_rng(2)
    n = 200
    base = rng.gamma(2.0, 30.0, (n, 4)) + 1
    rows = [(str(i), int(base[i, 0]), int(base[i, 1]), float(base[i, 2]), int(base[i, 3])) for i in range(n)]
    df = spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency long, Monetary double, Tenure int")
    out, evr = ml.pca_3d(df)
    pdf = out.orderBy("CustomerID").toPandas()
    raw = np.log1p(np.array([[r[1], r[2], r[3], r[4]] for r in sorted(rows)], dtype=float))
    z = (raw - raw.mean(0)) / raw.std(0)
    w, v = np.linalg.eigh(np.cov(z, rowvar=False))
    order = np.argsort(w)[::-1]
    w, v = w[order], v[:, order]
    for j in range(3):
        col = v[:, j] * (1 if v[np.abs(v[:, j]).argmax(), j] >= 0 else -1)
        assert np.allclose(pdf[f"PCA_{j + 1}"].to_numpy(), np.round(z @ col, 4), atol=2e-4)
    assert np.allclose(evr, np.round(w[:3] / w.sum() * 100, 2), atol=0.011)


def test_cluster_names_are_canonical(spark):
    rows = [(str(i), float(m), 0 if m < 50 else 1) for i, m in enumerate([10, 20, 30, 100, 200])]
    df = spark.createDataFrame(rows, "CustomerID string, Monetary double, prediction int")
    named = {r.CustomerID: r.ML_Cluster for r in ml.canonical_cluster_names(df).collect()}
    assert named["4"] == "Cluster 1" and named["0"] == "Cluster 2"


def _customers(spark):
    rows = [(str(i), seg, float(aov)) for i, (seg, aov) in enumerate(
        [("Champions", 100), ("Champions", 200), ("Champions", 300), ("Loyalists", 50), ("Champions", 10)])]
    return spark.createDataFrame(rows, "CustomerID string, Segment string, AvgOrderValue double")


def test_campaign_roi_and_empty_segment_default(spark):
    roi = {r.Segment: r for r in camp.campaign_roi(_customers(spark)).collect()}
    ch = roi["Champions"]
    assert ch.Audience == 3 and ch.AvgSegmentAOV == 152.5          # int(4 * 0.8) = 3
    assert ch.ProjectedRevenue == float(np.round(3 * (8.5 / 100.0) * 152.5, 2))
    empty = roi["New Customers"]
    assert (empty.SegmentCustomers, empty.Audience, empty.AvgSegmentAOV) == (0, 0, 150.0)
    assert empty.ROIPct == -100.0 and empty.CostPerConversion == 3500.0


def test_audience_takes_first_ids_per_segment(spark):
    aud = camp.campaign_audience(_customers(spark), reach_pct=80).collect()
    got = sorted((r.Segment, r.CustomerID) for r in aud)
    assert got == [("Champions", "0"), ("Champions", "1"), ("Champions", "2")]


def test_roi_grid_sizes(spark):
    grid = camp.roi_grid(_customers(spark), reach=(10, 100, 45), budget=(500, 1000, 500),
                         conversion=(1.0, 2.0, 0.5), margin=(40, 40, 5))
    assert grid.count() == 7 * 3 * 2 * 3 * 1
    best = camp.best_scenarios(grid).where(F.col("Segment") == "Champions").first()
    assert best.Budget == 500.0 and best.ReachPct == 100.0
