"""Tables, binary log formats and JSON bodies as DataFrames."""
