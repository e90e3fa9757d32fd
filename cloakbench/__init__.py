"""Spark-native analytics for measuring how PII detectors hold up under adversarial text."""
