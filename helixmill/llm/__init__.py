"""Training-data operators over a table of documents; nothing else in the library imports this package."""
