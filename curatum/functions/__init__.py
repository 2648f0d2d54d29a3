"""Functions of the curation library."""
