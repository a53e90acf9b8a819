"""Spark-native document retrieval, question answering and text analytics."""
