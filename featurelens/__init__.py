"""featurelens: analytics over collections of items described by numeric features.

Every public operator is a function ``(DataFrame, params) -> DataFrame`` whose
work runs on Spark. Sub-packages:

* ``sources``   - table loading, nested JSON scans, stage tables and sinks
* ``functions`` - column expressions (rounding, cosine kernel, id parsing, ...)
* ``operators`` - relational, statistical and feature-space operators
* ``plans``     - the query catalogue bound to the benchmark tables
* ``streaming`` - incremental landing of raw JSON payloads
"""

from featurelens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
