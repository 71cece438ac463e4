"""Column functions: paths, charsets, CSS and encodings."""
