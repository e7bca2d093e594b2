"""Plans: operators put together."""
