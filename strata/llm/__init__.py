"""Operators for preparing training data: sharding, search, mixing, joins, scoring, packing, extraction."""
