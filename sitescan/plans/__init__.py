"""Registered queries and the views they run on."""
