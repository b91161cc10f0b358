"""Compositions of operators into end-to-end jobs."""
