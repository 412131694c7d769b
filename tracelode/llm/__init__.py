"""Operators over training texts and mergeable sketches; nothing else in the library imports this."""
