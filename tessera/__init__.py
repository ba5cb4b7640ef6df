"""Tessera: statistical data processing expressed as Spark DataFrame plans.

operators  relational and statistical operators, models and graph operators
functions  column builders (kernels, converters, text measures)
sources    readers and writers
plans      named queries with their reference SQL
streaming  Structured Streaming operators
"""
