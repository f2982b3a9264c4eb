"""Analytics over media-library metadata as DataFrame and SQL operations."""
