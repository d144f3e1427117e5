"""Operators for preparing large training corpora; each module holds one operator, ``catalog`` their queries."""
