"""Column and column-staging functions: normalisation, classification, hashing, formatting."""
