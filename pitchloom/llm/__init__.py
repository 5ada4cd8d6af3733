"""Operators that prepare corpora and training tables; nothing outside this subpackage imports it."""
