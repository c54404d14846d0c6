"""Transaction and complaint analytics as Spark DataFrame plans."""
