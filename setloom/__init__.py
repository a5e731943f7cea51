"""Set-sequence analytics on Spark: ordered draws of small number sets, as DataFrames."""
