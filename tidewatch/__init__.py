"""Spark-native analytics over network-behaviour telemetry."""
