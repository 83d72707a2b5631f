"""The audit's operators, grouped by the kind of evidence they read."""
