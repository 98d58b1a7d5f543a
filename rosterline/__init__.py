"""rosterline — a Spark-native engine for building contact and account lists.

Every operator is a pure function: DataFrames (or Columns) in, DataFrames (or
Columns) out.  Nothing is collected to the driver; dimension tables are small
and broadcast only where their size is bounded.
"""

from rosterline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
