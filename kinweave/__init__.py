"""Record linkage and data quality as PySpark DataFrame operators."""
