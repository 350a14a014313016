"""veil — privacy-aware dialogue and text analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected to the driver except results that are
bounded by a parameter (a vector of model dimension, a handful of scalars).
"""

from veil.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
