"""Release histories and other inputs derived from the star-schema test tables."""
