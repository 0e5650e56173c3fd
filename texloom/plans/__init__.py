"""Parsers: patterns, operator chains and templates. No Spark here."""
