"""codexmill: a Spark-native analytics engine for encyclopedia-scale corpora."""
