"""Profile search, sequence statistics and mixture models as Spark DataFrame transformations."""
