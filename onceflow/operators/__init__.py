"""Set-based decisions, transitions, audit, metrics and the source scanner."""
