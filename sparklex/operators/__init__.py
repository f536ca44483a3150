"""Tokenization stages: each is a spec with expr(Column) -> Column."""
