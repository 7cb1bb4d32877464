"""tidemark: labelled-interval and document analytics on PySpark DataFrames."""
