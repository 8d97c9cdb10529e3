"""A Spark-native engine for building, selecting, verifying and analysing text corpora."""
