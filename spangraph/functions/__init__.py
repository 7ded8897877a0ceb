"""See README for the operator list."""
