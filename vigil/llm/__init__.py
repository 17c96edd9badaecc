"""Operators of a training-data pipeline over web-scale text: de-duplication, filtering, scoring, packing, sharding."""
