"""Jobs over tables: each function takes DataFrames and returns DataFrames."""
