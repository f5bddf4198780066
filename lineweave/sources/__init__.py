"""Readers and writers of subtitle, script, word-timing and glossary files."""
