"""auditframe: DataFrame operators that audit legacy systems on Spark.

Every operator takes and returns DataFrames and is built from Spark SQL
functions, joins, aggregations and windows.
"""

__version__ = "0.1.0"
