"""Spark-native file-context analytics: manifests, extraction, search, graphs, relations, journals and watch streams."""
