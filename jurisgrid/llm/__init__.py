"""Training-data operators on text; nothing outside this subpackage imports it."""
