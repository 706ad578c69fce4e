"""Operators for language-model corpora; nothing outside this subpackage imports it."""
