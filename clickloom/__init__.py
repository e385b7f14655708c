"""clickloom: a PySpark-native engine for click-through-rate data and training corpora."""
