"""clausemill: retrieval, grounded-QA evaluation and text-data processing on PySpark.

Every operator is a function from DataFrames to a DataFrame; plans are declared with the
DataFrame API and left to Catalyst and AQE.
"""
