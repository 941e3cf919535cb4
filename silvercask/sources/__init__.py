"""Files of attributes, rule tables and captured JSON as DataFrames."""
