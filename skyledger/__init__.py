"""Spark operators for schedule-and-outcome tables. Every operator takes DataFrames and returns one."""
