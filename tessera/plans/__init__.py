"""Plans over the shared tables: the registered queries and their SQL."""
