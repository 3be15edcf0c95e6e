"""Operators for preparing text for language models; nothing else in pagemill imports this subpackage."""
