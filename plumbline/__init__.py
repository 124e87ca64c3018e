"""Data profiling and data quality on Spark DataFrames.

``operators`` hold the work, ``functions`` the column expressions they share, ``sources`` reading
and writing, ``plans`` the registered queries with their SQL equivalents.
"""
