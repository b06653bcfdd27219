"""Plans: the named query catalogue, its SQL twins, exports and the prefix-sum plan."""
