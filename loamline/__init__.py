"""Spark-native corpus memory: notes in, entity graph, probes, links and ranked passages out."""

__version__ = "0.1"
