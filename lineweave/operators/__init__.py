"""Relational and sequence operators on cues, scripts, glyphs and usage."""
