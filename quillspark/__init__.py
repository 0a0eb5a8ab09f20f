"""Literature-screening analytics and training-data operators on PySpark."""
