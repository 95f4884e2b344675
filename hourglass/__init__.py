"""hourglass: Spark-native hourly-demand analytics and forecasting.

Every public operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL / DataFrame / MLlib primitives, so Catalyst plans it and the
cluster scales it.  Sub-packages:

* ``sources``   – reading tables and records, model artefacts, metric sinks.
* ``functions`` – reusable column expressions (calendar, guards, hashing).
* ``operators`` – cleaning, profiling, ordering, features, splits, models,
  evaluation, registry and scoring operators.
* ``plans``     – named compositions (derived views and the query catalogue).
* ``streaming`` – Structured Streaming forms of resampling and scoring.
"""

__version__ = "0.1.0"
