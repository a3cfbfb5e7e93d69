"""Siftwell: a Spark-native search engine over file trees, symbols and text."""
