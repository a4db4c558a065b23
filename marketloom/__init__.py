"""Spark-native engine for audited market observations.

Layout: ``operators`` (relational kernels and data-quality operators),
``sources`` (scans and sinks), ``functions`` (scalar column functions),
``plans`` (query catalogue and its SQL oracles), ``streaming`` (incremental forms).
"""
