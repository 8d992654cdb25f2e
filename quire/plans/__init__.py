"""Registered queries, and jobs made of several operators."""
