"""Spark-native dataset curation and analytics: DataFrame operators for captions, files, metadata, joins, roll-ups and streams."""
