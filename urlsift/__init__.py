"""URL-catalogue ETL and analytics on Spark DataFrames."""
