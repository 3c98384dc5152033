"""Dictionaries, uploads and sinks."""
