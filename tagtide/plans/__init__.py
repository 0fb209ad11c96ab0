"""Query specifications and the planner that turns them into DataFrames."""
