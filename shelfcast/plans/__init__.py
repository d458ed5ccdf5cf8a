"""Registered queries: operators applied to the star-schema tables, each with its oracle SQL."""
