"""Column functions: text, dates, ratings, paths, names."""
