"""Spark-native engine for collecting, cleaning, scoring and auditing semi-structured postings."""
