"""Spark-native measurement studies over labelled text: label, collapse, tabulate, test."""
