"""Spark-native workbench over query results, data movement and database code."""
