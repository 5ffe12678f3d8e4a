"""Reading, writing and checking tables."""
