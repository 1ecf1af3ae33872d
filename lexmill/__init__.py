"""A search and filtering engine over typed document collections, on PySpark."""
