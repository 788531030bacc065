"""Sinks that stay right when tasks fail and writers meet."""
