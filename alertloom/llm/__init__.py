"""Operators of a training-data pipeline: records, duplicates, mixing, scoring, packing, sketches."""
