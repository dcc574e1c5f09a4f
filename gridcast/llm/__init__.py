"""Operators of a training-data pipeline: mixing, quality, near and substring deduplication, token files, search,
tokenizing, language, URL rules and fingerprints. Nothing outside this folder imports it."""
