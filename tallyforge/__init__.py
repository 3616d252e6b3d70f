"""tallyforge: Spark-native analytics over SQL workloads, their cost and their findings."""
