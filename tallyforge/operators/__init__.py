"""Relational and statistical operators over draft facts."""
