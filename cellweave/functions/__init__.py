"""Column functions: text normalisation, serialisation, parsing and vector arithmetic."""
