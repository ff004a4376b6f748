"""Rows that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, lines int, node string"

#: Ids, texts: nulls, empties, blanks, ties, repeated rows, odd white space, a very long text.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(n, seed):
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 20) % 97))
    return " ".join(out)


def odd_rows():
    long = passage(30000, 99)
    a, b, c = passage(60, 1), passage(60, 2), passage(40, 3)
    texts = [
        (1, a),
        (2, a),
        (3, f"{passage(20, 4)} {c} {passage(20, 5)}"),
        (4, f"{passage(20, 6)}\n{c}\n{passage(20, 7)}"),
        (5, None),
        (6, ""),
        (7, " \n\t \x0b"),
        (8, "one two"),
        (8, "one two"),
        (9, a.replace(" ", "\n", 30) + " x"),
        (None, b),
        (None, None),
        (10, b),
        (11, "naïve café 日本語 \U0001f642 <|endoftext|> it's  two  spaces\r\n\r\nend "),
        (12, "spam " * 400),
        (13, "\n".join([passage(12, 8), passage(12, 9), passage(12, 8), "", passage(12, 10)])),
        (14, "\n".join([passage(12, 11), passage(12, 9), passage(12, 10), passage(12, 12)])),
        (15, long),
        (16, long + " tail"),
        (17, b.replace("alpha", "omega", 1)),
        (-3, "MIT License. Licensed under the Apache License, Version 2.0; see the GNU General Public License v3 or mit-license"),
        (18, "x" * 5000),
        (19, b.rsplit(" ", 1)[0] + " changed"),
    ]
    return [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or ""), "clash", 7, "n") for i, t in texts]


def words(text):
    return (text or "").encode().split()
