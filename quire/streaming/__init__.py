"""Operators on streams of transcripts."""
