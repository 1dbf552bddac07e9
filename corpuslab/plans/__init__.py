"""Table views, whole experiments and the query catalogue."""
