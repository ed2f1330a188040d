"""Tables, files and what lies in files, as DataFrames."""
