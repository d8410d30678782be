"""PySpark-native analytics engine for literature-derived solvent-extraction measurements."""
