"""Corpus preparation: de-duplication, filtering, scoring, search, mixing, encoding."""
