"""retail_insight: customer analytics for retail transactions on Spark.

Every public operator takes and returns a lazy ``pyspark.sql.DataFrame``
and is built from the DataFrame / SQL API, so Catalyst plans it and the
work runs on the executors; the k-means and silhouette inner loops use
``mapInPandas`` (numpy inside each task).

Layout:

* ``sources``    readers (CSV, parquet, driver tables) and sinks
* ``functions``  column-level helpers (rounding, day spans, trimming)
* ``operators``  ingest, features, ranking, scores, segments, value,
                 cohorts, clustering, campaigns
* ``plans``      composed pipelines (customer table, action plan)
* ``streaming``  no operators (the analytics read whole files in batch)
"""

from retail_insight.session import ensure_checkpoint_dir, get_session

__all__ = ["ensure_checkpoint_dir", "get_session"]
