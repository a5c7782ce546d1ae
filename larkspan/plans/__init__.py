"""Whole jobs: scoring, comparison, run metrics, generation, training, graphs, learning."""
