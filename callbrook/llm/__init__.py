"""Operators for building training corpora: filters, near-duplicate removal, mixing, packing, search."""
