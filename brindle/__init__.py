"""Brindle: utterance analytics and corpus engineering as plain PySpark DataFrame programs."""
