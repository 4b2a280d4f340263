"""vigilake: a Spark-native engine for security analytics and corpus preparation."""
