"""Reading and writing facts."""
