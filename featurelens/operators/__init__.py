"""Relational, statistical and feature-space operators (DataFrame in, DataFrame out)."""
