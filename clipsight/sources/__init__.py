"""File readers and writers for the formats the curation workflow exchanges."""
