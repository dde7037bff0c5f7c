"""Registered queries, their oracle SQL, and the comparison of the two."""
