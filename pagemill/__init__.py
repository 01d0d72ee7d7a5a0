"""Document-structure analytics expressed as PySpark DataFrame transformations."""
