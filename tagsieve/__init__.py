"""Annotation error detection and annotation data processing as Spark DataFrame operators."""
