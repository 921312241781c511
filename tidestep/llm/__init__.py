"""Training-data operators: tokens, fingerprints, near duplicates, decontamination and more."""
