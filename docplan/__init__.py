"""Document analytics compiled to Spark DataFrame plans."""
