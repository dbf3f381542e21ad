"""weft: a PySpark-native engine for property graphs, typed graphs and message passing."""
