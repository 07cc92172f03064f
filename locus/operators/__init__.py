"""Jobs on tables."""
