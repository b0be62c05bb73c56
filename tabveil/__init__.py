"""Differentially private synthetic tables on Spark."""
