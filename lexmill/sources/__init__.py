"""Reading articles, and writing index state."""
