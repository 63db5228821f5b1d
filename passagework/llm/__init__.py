"""Operators of a training-data pipeline: scans, fingerprints, joins, packing, scoring."""
