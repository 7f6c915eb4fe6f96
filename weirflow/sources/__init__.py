"""Readers: tables, trees of files, delimited text, office documents."""
