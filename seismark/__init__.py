"""Regime-shift analytics over large collections of series, and operators for training-data pipelines, on PySpark."""
