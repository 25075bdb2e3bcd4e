"""Eventide: a PySpark-native engine for event-catalogue analytics."""
