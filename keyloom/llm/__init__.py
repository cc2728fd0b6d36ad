"""Operators for building training corpora: mixing, sharding, PII, token files, language ID,
fingerprints, near-duplicates, telephony audio, URL filters and sequence packing."""
