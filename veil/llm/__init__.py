"""Operators of a training-data pipeline: scoring, tokens, quality, language,
duplicates, contamination, personal data and secrets.  Nothing else in the
library imports this subpackage."""
