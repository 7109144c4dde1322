"""Record matching, correlation and data-preparation operators on PySpark DataFrames."""
