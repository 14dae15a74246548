"""strata — Spark-native medallion analytics.

Reusable DataFrame operators for bronze → silver → gold pipelines, stream
queries, semantic measures, data contracts and Spark ML model lifecycle.
Every operator takes and returns a ``pyspark.sql.DataFrame`` (or builds a
``Column``) so Catalyst sees one logical plan end to end.
"""

from strata.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
