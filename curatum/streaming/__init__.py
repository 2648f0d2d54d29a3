"""Streaming of the curation library."""
