"""Answer selection, evaluation and training-data preparation on Spark DataFrames."""
