"""Spark-native log analytics, document archive and corpus operators."""
