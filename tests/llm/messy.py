"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = " ".join(f"word{i % 977} the" for i in range(60_000))
ODD = [
    "a  b   c", "tab\there\nnew  line ", "  lead", "trail  ", "it's we'll 'S <|endoftext|>x <|startoftext|> y",
    "café naïve İstanbul ΣΑΣ ß", "nb sp  em \x1c fs \x85 nel", "é combining ́", "一二三 \U0001f600\U0001f600 x",
    "1234 12.5 a1b2", "...", "\n\n\n", " ", "THE The the tHe", "x" * 3000, "a,b. c,", "× ÷ ²",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, kept string, fp string, component_id string, pii string, start string, copies string, raw string, block string"


def rows():
    near = "The quick brown fox jumps over the lazy dog while many small birds sing in the old green garden near the river bank every day"
    texts = [None, "", LONG, LONG, near, near, near + " again", *ODD, *[f"{near} number {i} {i * 7}" for i in range(12)]]
    base = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else ("src1" if i % 5 else None), None) for i, t in enumerate(texts)]
    base += [(4, near, "en", "src0", 3), (None, near, None, None, None), (None, None, None, None, None), (4, "other text of the same id", "en", "src1", 1)]
    return [(*r, *["clash"] * 10) for r in base]


def frame(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
