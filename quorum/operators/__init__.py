"""Relational operators over votes, questions, images, readouts and records."""
