"""Spark-native data profiling, guarded SQL and AutoML.

Entry points (all take and return DataFrames):

* ``tablelens.operators.insights.analyze`` — every profiling result of a table
  (profile, statistics, identifiers, quality, distributions, correlations,
  insights, report) from one shared scan;
* ``tablelens.operators.sqlrun.run_sql`` and ``tablelens.operators.templates``
  — guarded read-only SQL and ready aggregates;
* ``tablelens.operators.targets``, ``.prep``, ``.automl``, ``.scoring`` —
  target ranking, leakage, preparation, model benchmark and batch scoring;
* ``tablelens.sources.csv`` — typed CSV reading and validation.
"""
