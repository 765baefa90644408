"""Table operators shared by the reports. Each takes and returns DataFrames."""
