"""obsflow: telemetry-evidence operators on Spark DataFrames."""
