"""seriesloom: panel time-series features, backtests and forecast evaluation on PySpark.

Every operator takes and returns DataFrames keyed by a series identifier and a
timestamp. The row order inside a series is never rebuilt in one task: see
``seriesloom.operators.positions`` and ``seriesloom.operators.chunks``.
"""

__version__ = "0.1.0"
