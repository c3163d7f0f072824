"""Relational operators over fact tables."""
