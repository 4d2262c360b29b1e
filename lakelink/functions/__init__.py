"""Column functions: text normalisation, tokenisation, similarity."""
