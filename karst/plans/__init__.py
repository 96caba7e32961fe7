"""Named queries over the tables, and the planner from questions to queries."""
