"""Rows that every operator on texts must take."""

EDGES = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t", "en", None),
    (4, "one two", "en", "a"),
    (4, "one two", "en", "a"),
    (5, "One TWO", "en", "a"),
    (6, "word " * 30000, "en", "a"),
    (7, "schöne Grüße 漢字 😀 #*$", "de", "b"),
]
