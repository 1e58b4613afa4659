"""Operators on event tables: normalisation, merging, search, detection, correlation, matching."""
