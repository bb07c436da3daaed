"""Operators for building and auditing training data. Nothing outside this subpackage imports it."""
