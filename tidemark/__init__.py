"""Mail and task accountability analytics expressed as Spark DataFrames."""
