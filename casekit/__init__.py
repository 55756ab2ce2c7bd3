"""casekit: labelled case-table analytics on Spark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built
on ``pyspark.sql.functions`` and ``pyspark.ml``; nothing is collected to the
driver except bounded, per-class or per-model summaries.
"""

from casekit.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
