"""Spark-native analytics over build, CI and application logs."""
