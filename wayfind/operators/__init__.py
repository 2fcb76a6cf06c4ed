"""Relational operators over the engine relations."""
