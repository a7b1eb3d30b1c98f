"""Plans over streams.

The engine's queries are batch queries: the algebra has no windows, watermarks or state. A plan of scans, filters and
projections has no state either, so lower() takes streaming DataFrames as tables as they are; sorts and crosses are refused
by Spark itself. Nothing else is needed here.
"""
