"""The reports. Each takes DataFrames and typed parameters and returns one DataFrame.

Final sorts carry the report's order plus enough further columns to tell rows apart, so
that the range partitions of a global sort stay even when one sort value is frequent.
"""
