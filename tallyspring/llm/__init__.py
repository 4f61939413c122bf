"""Operators on texts: token ids, containers, subject areas. Nothing outside this subpackage imports it."""
