"""A Spark-native engine for harmonising and analysing material catalogues."""
