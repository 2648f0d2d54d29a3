"""Operators of the curation library."""
