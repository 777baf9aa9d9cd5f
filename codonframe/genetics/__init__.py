"""The genetic code and the two lookup tables derived from it."""
