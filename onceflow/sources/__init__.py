"""Ledger storage and readers."""
