"""groundspark: Spark-native grounding analytics for question-answering traces."""
