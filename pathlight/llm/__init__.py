"""Operators for preparing training data: one module each, and ``queries`` with a registered query for every one."""
