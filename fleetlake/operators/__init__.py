"""Relational, sequence and rule operators."""
