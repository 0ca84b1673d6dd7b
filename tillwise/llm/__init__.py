"""Operators for preparing training data: filtering, scoring, deduplicating, mixing and rendering text."""
