"""newsloom: news-event resolution and attention analytics on Spark DataFrames."""
