"""Sources of the curation library."""
