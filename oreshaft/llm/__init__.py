"""Training-data operators: filtering, deduplication, decontamination, mixing."""
