"""Readers that turn landed exports into document DataFrames, and keyed sinks."""
