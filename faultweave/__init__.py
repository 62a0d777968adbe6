"""faultweave: failure diagnosis of data jobs from their event logs, on PySpark.

Every operator takes and returns DataFrames and runs no action of its own,
except where a docstring says so (model training, graph loops, writers).
"""

__version__ = "0.1.0"
