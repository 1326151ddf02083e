"""Detection and investigation over security event tables, on Spark DataFrames."""
