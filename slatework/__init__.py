"""A Spark-native select-project-join-order engine."""
