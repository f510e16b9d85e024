"""papyra: a Spark-native engine for document collections and tabular sheets."""
