"""Operators on DataFrames: scoring, deduplication, moves, correlation and their assembly."""
