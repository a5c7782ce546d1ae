"""Table readers and file formats."""
