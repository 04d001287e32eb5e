"""Training-data operators on document, label and embedding tables; nothing else in the library imports this subpackage."""
