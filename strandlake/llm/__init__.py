"""Training-data operators on text tables; nothing outside this subpackage imports it."""
