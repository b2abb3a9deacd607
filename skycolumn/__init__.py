"""Analytics for vertically profiling instruments, written for Spark DataFrames."""
