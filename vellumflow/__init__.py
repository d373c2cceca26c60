"""A Spark-native engine for collecting, curating, mining and classifying collections of research documents."""
