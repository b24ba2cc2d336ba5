"""inkstat: prose measurement and text-corpus processing on Spark."""
