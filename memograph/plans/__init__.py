"""Reusable physical patterns: ordered scans, range joins, top-k, neighbour joins."""
