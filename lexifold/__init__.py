"""Classification of partly labelled text with Spark DataFrames and Spark ML."""

__version__ = "0.1.0"
