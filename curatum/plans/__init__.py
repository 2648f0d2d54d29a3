"""Plans of the curation library."""
