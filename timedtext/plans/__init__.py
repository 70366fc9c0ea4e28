"""Plans: the page planner and the whole book."""
