"""Operators over library frames: predicates, result sets, playlists, ratings, reports, tags, pages."""
