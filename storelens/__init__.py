"""storelens — app-marketplace analytics as Spark DataFrame jobs.

Sub-packages:
  functions  Column -> Column builders (text cleaning, PII masks, normalisers)
  sources    table readers, stand-in views over the driver tables, sinks
  operators  DataFrame -> DataFrame jobs (firewall, prices, reviews, ...)
  plans      reusable skew-safe plan shapes and the named query registry
  streaming  Structured Streaming twins of the batch jobs
"""

__all__ = ["session"]
