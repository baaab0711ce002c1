"""Column -> Column building blocks; everything here is row-local."""
