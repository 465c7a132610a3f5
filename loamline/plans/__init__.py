"""Pipelines made of the operators, and their persistence."""
