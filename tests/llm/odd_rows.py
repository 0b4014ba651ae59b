"""Awkward documents, and words as the operators define them."""

import re

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two three four."), (None, "no id at all here now"),
    (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, "A b c D e f g h i j"), (9, LONG), (10, LONG + " tail"),
    (11, "naïve café 日本語 🙂 \r\n\r\n x"), (12, "x" * 30_000), (13, "  two  blanks  and\n\n lines\n"),
    (14, "<|endoftext|> it's they'll 1234 !!!"), (15, "\x00 \x1c \x85 end"),
]
# names that operators use inside must not clash with the table's own
EXTRA = ["_id", "t", "_t", "node", "ids", "size", "shard", "n_words", "failed", "label", "html", "host", "key"]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", low) if w]
