"""loomgraph: Spark-native analytics over structured diagram data."""
