"""Operators that prepare text and code for language models. Nothing outside this package imports it."""
