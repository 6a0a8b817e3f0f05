"""Corpus preparation operators. Nothing outside this folder imports it."""
