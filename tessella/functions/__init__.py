"""Integer functions on columns, index algebra of views, and error values."""
