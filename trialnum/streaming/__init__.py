"""The row-local plans on streaming input."""
