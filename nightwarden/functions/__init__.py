"""Column builders shared by the batch and streaming plans."""
