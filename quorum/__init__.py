"""quorum: a Spark-native engine for annotation datasets (votes, targets, splits, calibration, checks)."""
