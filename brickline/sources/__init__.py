"""Readers that turn landed files into tidy frames, and the table writers."""
