"""Corpus audit on Spark: pattern rules, repository-wide checks and corpus statistics."""
