"""Fathom: a PySpark-native engine for searching and analysing source-code corpora."""
