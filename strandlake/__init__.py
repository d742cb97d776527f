"""strandlake: cohort-genomics table operators for Spark DataFrames."""
