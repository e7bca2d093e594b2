"""Reading crawls and writing results."""
