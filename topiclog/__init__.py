"""topiclog: ordered topic logs and their delivery semantics on Spark DataFrames."""
