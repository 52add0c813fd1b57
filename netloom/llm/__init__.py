"""Operators for building text corpora: extraction, scoring, deduplication, mixing, encoding."""
