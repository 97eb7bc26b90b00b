"""Spark-native analytics over yearly n-gram counts, sentence corpora and word vectors."""
