"""Particle tables on Spark: box, attribute and level-of-detail queries as DataFrames."""
