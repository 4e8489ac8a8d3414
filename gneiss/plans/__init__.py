"""Plans: the read-only gate, paging and plan inspection."""
