"""Label-quality analytics on Spark DataFrames.

Importing the package never creates a SparkSession. Every operator takes DataFrames (or Columns) and
returns DataFrames (or Columns); the plans package wires operators to the benchmark tables.
"""

__version__ = "0.1.0"
