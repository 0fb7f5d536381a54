"""Crisis-report triage on Spark DataFrames."""
