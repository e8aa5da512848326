"""Writers of dataset files."""
