"""ratebook."""
