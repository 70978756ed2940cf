"""Training-data operators: filtering, de-duplication, mixing, archives, tokens."""
