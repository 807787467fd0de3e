"""driftloom: Spark-native analytics over versioned interface definitions."""
