"""Whole jobs, and the registry of queries with their oracle SQL."""
