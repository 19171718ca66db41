"""Small tables of awkward texts."""


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, `_row` array<int>"
LONG = " ".join(f"word{i % 977} é{i}" for i in range(120_000))
CLEAN = "The quick brown fox jumps over the lazy dog while seven wizards mix potions near the old mill. " * 3
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "one two three"), (6, CLEAN), (7, CLEAN), (8, CLEAN.replace(" ", "  ")), (9, CLEAN.upper()),
    (10, LONG), (11, LONG + " tail"), (12, "été ñandú 😀   x" * 40), (13, "x" * 300_000), (14, "###$$$ %%% &&& ||| <<< >>>\n" * 30), (15, "Released under the MIT License."),
    (None, "no id at all"), (None, "no id at all"), (6, CLEAN), (16, "tab\tsep\r\nline\n\nline\nline"), (17, "word " * 200), (18, "<|endoftext|> is text's own; it'll do 12345 don't"),
]


def docs(spark, texts=None, partitions=3):
    rows = [(i, t, None if i == 4 else "en", None if n % 7 == 3 else f"s{n % 3}", len(t or ""), "k", n, [n]) for n, (i, t) in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)
