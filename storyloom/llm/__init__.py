"""Training-data operators on text. Nothing outside this folder imports it."""
