"""Readers that turn repositories and tables into engine relations."""
