"""Training-data operators: quality, dedup, decontamination, mixing, tokens, archives, chat."""
