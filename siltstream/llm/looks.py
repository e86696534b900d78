"""One stored form for texts that look the same (problem 9).

DuckDB runs inside each Arrow partition. Its SQL removes invisible characters by regular expression, maps
blanks, full-width forms and look-alike letters with ``translate``, spells out joined letters with ``replace``
and composes accents with ``nfc_normalize``. What a reader can see (accents, case, the shape of quotes and
dashes, raised digits) stays. NFKC is not used because it would also flatten raised digits and fractions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.session import materialize, spread

# Characters without a visible shape (soft hyphen, joiners, marks of direction, BOM, fillers).
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b"
    "\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
)
# Ranges of variation selectors, interlinear marks and tags, which are invisible too.
INVISIBLE_RANGES = (("\ufe00", "\ufe0f"), ("\ufff9", "\ufffb"), ("\U000e0001", "\U000e0001"), ("\U000e0020", "\U000e007f"), ("\U000e0100", "\U000e01ef"))
# Kinds of blank that stand for one space.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letters of Cyrillic, Greek, Armenian and Cherokee that are drawn like a Latin letter, and the Latin letter.
# Mathematical, circled and small-capital letters are not among them: a reader sees that they are set differently.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ό": "ó", "ϳ": "j",
    "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "Ϊ": "Ï", "Ϋ": "Ÿ",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϲ": "c", "Ϲ": "C", "Ϳ": "J", "ά": "á", "ί": "í", "ύ": "ú", "ϊ": "ï", "ϋ": "ü",
    "ց": "g", "հ": "h", "զ": "q", "ո": "n", "ս": "u", "օ": "o", "Օ": "O", "Ս": "U", "Տ": "S",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
# Joined letters and what they join.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "Ǆ": "DŽ", "Ǉ": "LJ", "Ǌ": "NJ",
}
# Full-width forms are U+FF01 to U+FF5E, at a fixed distance from the ASCII characters they widen.
FULL_WIDTH = {chr(0xFF00 + i): chr(0x20 + i) for i in range(1, 0x5F)}
# Half-width forms of kana and Hangul have the ordinary form that their compatibility data name.
HALF_WIDTH = {chr(c): chr(int(unicodedata.decomposition(chr(c)).split()[1], 16)) for c in range(0xFF61, 0xFFF0) if unicodedata.decomposition(chr(c)).startswith("<narrow>") and chr(c) not in INVISIBLE}
FULL_WIDTH_SIGNS = {"｟": "⦅", "｠": "⦆", "￣": "¯", "￠": "¢", "￡": "£", "￢": "¬", "￥": "¥", "￦": "₩", "￤": "¦"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_to_one() -> dict[str, str]:
    return {c: " " for c in BLANKS} | FULL_WIDTH | FULL_WIDTH_SIGNS | HALF_WIDTH | LOOKALIKES


def looks_sql(column: str) -> str:
    """The DuckDB expression that brings ``column`` to its one form."""
    pairs = _one_to_one()
    ranges = "".join(f"{a}-{b}" for a, b in INVISIBLE_RANGES)
    seen = f"regexp_replace({column}, '[{INVISIBLE}{ranges}]', '', 'g')"
    for joined, letters in JOINED.items():
        seen = f"replace({seen}, '{joined}', '{letters}')"
    mapped = f"translate({seen}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))})"
    # Plain ASCII and composed Latin letters without joins are in their one form already.
    odd = "[^\\x00-\\x7E¡-¬®-ıĴ-ſ‐-‗‘-†]"
    return f"CASE WHEN regexp_matches({column}, '{odd}') THEN nfc_normalize({mapped}) ELSE {column} END"


class Looks:
    """Runs SQL over Arrow batches in an embedded DuckDB, one connection per task."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})

    def query(self, batch: pa.RecordBatch, select: str) -> pa.Table:
        self.db.register("batch", pa.Table.from_batches([batch]))
        try:
            found = self.db.sql(f"SELECT {select} FROM batch").to_arrow_table()
        finally:
            self.db.unregister("batch")
        return found

    def form(self, texts: pa.Array) -> pa.Array:
        """The texts in their one form, nulls kept."""
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return self.query(batch, f"{looks_sql('text')} AS text").column(0).combine_chunks()


def one_form(df: DataFrame, column: str = "text", into: str = "canonical") -> DataFrame:
    """``df`` with the column ``into``: the text of ``column`` in its one form.

    Nulls stay null, the empty text stays empty, a text of invisible characters alone becomes empty. All other
    columns pass through unchanged; a column that is already named ``into`` is replaced.
    """
    rest = [c for c in df.columns if c != into]
    df = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = df.withColumn(into, F.col(f"`{column}`").cast("string")).schema
    position = rest.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, looks.form(batch.column(position))], schema.names)

    return df.mapInArrow(run, schema)


def look_keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``raw`` and ``form``: digests of each text as stored and in its one form; null texts are left out."""
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).filter("text IS NOT NULL")
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Looks()
        select = f"id, unhex(md5(text)) AS raw, unhex(md5({looks_sql('text')})) AS form"
        for batch in batches:
            if batch.num_rows:
                yield from looks.query(batch, select).to_batches()

    return spread(texts).mapInArrow(run, f"id {kind}, raw binary, form binary")


def look_alike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_a`` < ``id_b`` whose texts are stored with different characters and look the same.

    Texts stored alike make no pair, nor do null texts. Empty tables give no rows. Only groups that hold two
    stored forms reach the join; a group of plain copies, however large, never does.
    """
    keys = materialize(look_keys(df, id_column, text_column), "looks")
    # First (form, raw) with partial aggregation, so a hot text is one row per task before the shuffle.
    stored = materialize(keys.groupBy("form", "raw").agg(F.count("*").alias("copies")), "stored")
    several = stored.groupBy("form").agg(F.count("*").alias("forms")).filter("forms > 1").select("form")
    variants = stored.join(several, "form", "left_semi").select("form", "raw")
    # Pairs of stored forms, which are few, and only then their members: no copies are ever set against each other.
    x, y = variants.select("form", F.col("raw").alias("raw_x")), variants.select("form", F.col("raw").alias("raw_y"))
    unlike = x.join(y, "form").filter("raw_x < raw_y").select("raw_x", "raw_y")
    rows = unlike.join(keys.select(F.col("raw").alias("raw_x"), F.col("id").alias("x")), "raw_x")
    rows = rows.join(keys.select(F.col("raw").alias("raw_y"), F.col("id").alias("y")), "raw_y")
    return rows.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
