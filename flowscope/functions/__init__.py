"""Column expressions: addresses and keys, sketch hashing, frame decoding, labels."""
