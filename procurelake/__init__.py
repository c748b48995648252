"""Spark-native lake for public-procurement tenders: raw releases to reports."""
