"""Streaming versions of grouped summaries; an extra beyond the batch operators."""
