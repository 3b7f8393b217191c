"""Waymark: timetabled event-log analytics and corpus preparation on Spark DataFrames."""
