"""Column functions: canonical bytes, identity, normalizers."""
