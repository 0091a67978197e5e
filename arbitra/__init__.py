"""Review-verdict analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. Nothing runs until the caller
asks for rows, except where a docstring says that a step is materialised.
"""
