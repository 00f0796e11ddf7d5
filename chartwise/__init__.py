"""chartwise: Spark-native label/feature analytics operators.

Every operator takes DataFrames and returns DataFrames; the work runs as
Spark jobs (aggregates, joins, windows, explode) and is deterministic under
repartitioning.
"""

__version__ = "0.1.0"
