"""Text- and code-intelligence operators expressed as Spark DataFrame plans."""
