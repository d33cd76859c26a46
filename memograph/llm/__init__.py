"""Training-data operators: de-duplication, extraction, scoring, mixing, tokenizing and binary output."""
