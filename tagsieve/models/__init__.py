"""Classifiers and taggers that give predictions and probabilities."""
