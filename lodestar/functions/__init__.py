"""Column functions: texts and URLs, vectors, and injected models."""
