"""Spark-native analytics for scanned verse, with text-corpus operators beside it."""
