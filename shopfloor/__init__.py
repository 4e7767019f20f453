"""Process-quality data engine on Spark: ordered shot records, leakage-free history, labels, splits and checks."""
