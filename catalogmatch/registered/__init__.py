"""The registered queries and their SQL twins, by topic."""
