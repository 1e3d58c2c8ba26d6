"""Record-risk analytics as PySpark DataFrame transformations."""
