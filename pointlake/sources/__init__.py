"""Readers and writers of particle files; each returns or takes a DataFrame."""
