"""Hybrid retrieval and ranking as DataFrame plans."""
