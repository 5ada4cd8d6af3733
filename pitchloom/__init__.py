"""pitchloom: event-anchored analytics and data preparation on Spark DataFrames."""
