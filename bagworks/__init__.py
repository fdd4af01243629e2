"""bagworks: multiset algebra and the analytics built on it, on Spark DataFrames."""
