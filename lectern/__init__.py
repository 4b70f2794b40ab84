"""Lectern: a Spark-native engine for studies of instructional video, transcripts and comments."""
