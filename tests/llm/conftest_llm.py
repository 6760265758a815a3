"""Rows for the tests of this folder."""

#: Texts that are awkward for one operator or another.
ODD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "one"), (5, "one two"), (5, "one two"), (6, "one two"), (None, "no id"), (None, "no id"), (7, "The quick brown fox. Jumps over!\nThe lazy dog? Yes.\n" * 3),
    (8, "Ünïcödé 日本語 text \x1c   with  spaces"), (9, "x" * 5000), (10, "word " * 3000), (11, "a@b.co +1 (555) 010-9999 10.0.0.1 4111 1111 1111 1111 token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\""), (12, "\\ \\_ </s>[INST] <|turn|>"),
]
