"""Readers of texts and subtitles."""
