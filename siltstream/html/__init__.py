"""A small HTML tree on the standard library: parsing, cleaning, Markdown, metadata."""
