"""Learning-analytics queries over curriculum documents, quiz events and class rosters, as Spark DataFrames."""
