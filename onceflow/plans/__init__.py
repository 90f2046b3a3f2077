"""Declarations and the engine that ties decisions, commits and dispatch together."""
