"""Feeds and prices: from bytes to rows."""
