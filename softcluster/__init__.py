"""softcluster: clustering and topic models as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames.  Heavy work runs as
Spark jobs over partitioned data; only k-row model state (centres, mixture
components, topic totals) ever reaches the driver.
"""

__version__ = "0.1.0"
