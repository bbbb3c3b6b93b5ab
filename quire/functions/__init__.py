"""Column functions: text contract, presentation, stemming."""
