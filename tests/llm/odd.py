"""Rows that operators must not stumble over."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, hash string, row int, entry int, "
    "bucket int, print string, `group` int, node int, key int, key0 int, place string, spans string, label int"
)
CLASHING = ("x", 1, 2, 3, "p", 4, 5, 6, 7, "pl", "sp", 8)


def rows_of(pairs):
    """Rows of documents with columns whose names the operators use themselves."""
    return [(id_, text, "en", "s", None, *CLASHING) for id_, text in pairs]


ODD = [
    (1, "One two three four five."),
    (2, "one  two\tthree four\nfive. "),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "Ünïcode ŝtuff 中文 𝔘 é"),
    (None, "no id here at all"),
    (7, "One two three four five."),
    (7, "One two three four five."),
    (8, "word " * 30000),
    (9, "a\x00b"),
    (10, "no id here at all"),
    (11, "!"),
]
