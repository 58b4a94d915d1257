"""lifetrail — customer-lifecycle analytics as Spark DataFrame operators.

Every analysis is a function ``DataFrame -> DataFrame`` over a
transaction-shaped table; nothing is collected to the driver except
tiny, bounded results (parameters, partition counts).
"""

from lifetrail.config import Params, cluster_settings, ensure_checkpoint_dir, get_session

__all__ = ["Params", "cluster_settings", "ensure_checkpoint_dir", "get_session"]
