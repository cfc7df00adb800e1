"""Operators for preparing training text: duplicates, secrets, fingerprints, packing, mixing, search and more."""
