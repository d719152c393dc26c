"""Spark-native curation, grading and evaluation of reasoning-text corpora."""
