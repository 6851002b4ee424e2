"""Column functions on text and documents."""
