"""Set-at-a-time analytics for classroom chat platforms, on Spark DataFrames."""
