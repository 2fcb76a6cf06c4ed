"""Composite plans: history, map, briefing and explain."""
