"""tidelog: event logs as DataFrames and streams on PySpark."""
