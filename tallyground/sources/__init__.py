"""Reading landed files and reading or writing the stored tables."""
