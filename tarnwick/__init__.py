"""Spark-native analytics over documents and the people, places and organizations they mention."""
