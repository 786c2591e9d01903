"""Trust scoring of text records, and the corpus work around it, as Spark DataFrame operators."""
