"""PySpark-native reversible pseudonymization engine."""
