"""Report and result writers."""
