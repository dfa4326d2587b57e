"""Spark-native purchase-price analytics.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers, writers, schemas), ``plans`` (whole queries
over the driver tables) and ``streaming`` (incremental ingest).
"""
