"""Spark-native analytics for sparse daily activity panels: snapshots, sequences, evaluation, blending."""
