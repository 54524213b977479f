"""Haplotype evidence and training-data analytics as Spark dataflows."""
