"""Change streams: reading, cleaning, writing and the latest-version table."""
