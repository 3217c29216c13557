"""Video and discussion analytics expressed as Spark DataFrame operators."""
