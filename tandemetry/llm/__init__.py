"""Operators for preparing training text at scale: filtering, deduplication, counting, scoring, packing and sharding."""
