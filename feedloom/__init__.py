"""feedloom: feed-item analytics as PySpark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a small
set of DataFrames for multi-output jobs), so chains compose with
``DataFrame.transform`` or through :mod:`feedloom.plans.stages`.
"""

__version__ = "0.1.0"
