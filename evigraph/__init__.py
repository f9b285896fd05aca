"""Evidence-graph analytics on Spark: typed facts in, answers as DataFrames out."""
