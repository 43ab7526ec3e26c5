"""Training-data operators: thirteen corpus operators, their queries and their oracle SQL."""
