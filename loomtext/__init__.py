"""loomtext: a PySpark-native engine that prepares, checks and reassembles multilingual text at corpus scale."""
