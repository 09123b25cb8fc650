"""deltaloom: a Spark-native engine for data reduction and similarity analytics."""
