"""Fleet telemetry analytics as Spark DataFrame transformations.

Every operator takes and returns DataFrames, works on all devices at once and receives the
evaluation instant as a parameter (``as_of``), never the wall clock.
"""
