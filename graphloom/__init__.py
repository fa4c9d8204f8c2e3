"""A PySpark-native engine for ontology-grounded question answering."""
