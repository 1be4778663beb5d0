"""ferrule: a Spark-native engine for industrial sensor time series.

Every operator is a lazy function ``DataFrame(s) -> DataFrame`` built from
Spark SQL expressions, joins, windows and Structured Streaming.
"""

from ferrule.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
