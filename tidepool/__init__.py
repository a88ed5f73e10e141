"""Note retrieval, conversation analytics and training-data operators on Spark DataFrames."""
