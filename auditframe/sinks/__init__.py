"""Writers for analysis results."""
