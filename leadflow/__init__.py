"""leadflow: campaign lead analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from native
Spark expressions and computes its answer for all campaigns at once; a
per-campaign "request" is a filter on the result.
"""

from leadflow.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
