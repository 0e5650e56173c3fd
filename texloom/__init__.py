"""A Spark-native text query and string-processing engine."""
