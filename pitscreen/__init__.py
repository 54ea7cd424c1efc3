"""Point-in-time equity research as Spark DataFrame transformations."""
