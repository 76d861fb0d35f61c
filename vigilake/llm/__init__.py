"""Operators that prepare text corpora; nothing outside this subpackage imports it."""
