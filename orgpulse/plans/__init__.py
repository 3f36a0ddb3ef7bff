"""Plans: the registry of named queries (with oracle SQL) and the full mart build."""
