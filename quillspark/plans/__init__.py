"""The queries of the catalogue, and their SQL."""
