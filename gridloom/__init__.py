"""gridloom: a PySpark engine for validating, reconciling and preparing tabular publications and their texts."""
