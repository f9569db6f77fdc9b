"""Log evidence on Spark: raw log lines in, compact queryable evidence out.

Every operator takes and returns DataFrames (or builds a Column); nothing here
runs a job unless its docstring says so.
"""

__version__ = "0.1.0"
