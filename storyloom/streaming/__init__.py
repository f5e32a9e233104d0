"""Streaming forms: sessions, windows and last states of unbounded timelines, with watermarks for late rows."""
