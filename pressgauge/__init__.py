"""News sentiment analytics as Spark jobs: operators take DataFrames and return DataFrames."""
