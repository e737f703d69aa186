"""Spark-native churn and retention analytics.

Every public operator is a ``DataFrame -> DataFrame`` function (or a column
expression builder) that composes with ``df.transform``.  Sub-packages:

* ``sources``   – readers and writers (CSV/parquet, fixture views, model persistence)
* ``functions`` – column-expression builders (bins, category maps, numeric helpers)
* ``operators`` – cleaning, integration, features, reports, ML, retention, experiments
* ``plans``     – plan-level helpers (size-checked broadcast, distributed row numbers,
                  lineage cuts, session defaults)
* ``streaming`` – micro-batch scoring of arriving customer files
"""

__version__ = "0.1.0"
