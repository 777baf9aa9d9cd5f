"""Query catalogues: every operator as a named query with its oracle SQL."""
