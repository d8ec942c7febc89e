"""Problem 4: one form for texts that look the same but are stored with different characters.

Compatibility normalisation to composed form, full case folding, one kind of blank, no
default-ignorable characters, and one letter for each set of look-alike letters. Texts of
ASCII alone never leave the JVM; the others are brought together by hash and normalised once per distinct value.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.skew import HOT_SHARE, lookup
from rankmill.operators.storage import materialize, spread

# Letters and hyphens whose glyph is that of an ASCII character in common fonts
# (from the public confusables data of Unicode Technical Standard 39), by script.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "Տ": "S",
    # Latin beyond ASCII
    "ɡ": "g",
    # hyphens
    "‐": "-", "‑": "-",
}

# Characters that pass for an ASCII one in some fonts only, or whatever their size (public confusables data).
# They count for comparisons, not for texts that are the same on screen.
NEAR_LOOKALIKES = {
    # Greek, Cyrillic and Armenian
    "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "ϳ": "j", "Ӏ": "l", "ӏ": "l", "ѵ": "v", "Ѵ": "V", "г": "r", "ա": "w", "գ": "q", "զ": "q", "ց": "g", "Լ": "L", "Ս": "U", "ռ": "n",
    # Latin beyond ASCII
    "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ı": "i", "ɩ": "i", "ƨ": "2", "ƽ": "5",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "ⲩ": "y", "Ⲭ": "X",
    # marks
    "‘": "'", "’": "'", "‛": "'", "′": "'", "‚": ",", "‒": "-", "–": "-", "−": "-", "⁃": "-", "∕": "/", "⁄": "/", "∗": "*", "∶": ":", "∣": "|",
}

# The ranges of Default_Ignorable_Code_Point in the public Unicode data.
IGNORABLE = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
#: Kinds of compatibility mapping that change what is seen (a superscript two isn't a two).
SEEN = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>"}

_ignorable = re.compile(f"[{IGNORABLE}]+")
_blank = re.compile(r"[^\S\t\n\r\v\f]")
_lookalike = str.maketrans(LOOKALIKES)
_any_lookalike = str.maketrans(LOOKALIKES | NEAR_LOOKALIKES)
_kept: dict[str, bool] = {}


def _is_kept(ch: str) -> bool:
    known = _kept.get(ch)
    if known is None:
        known = _kept[ch] = unicodedata.decomposition(ch).split(" ")[0] in SEEN
    return known


def visible_form(text: str) -> str:
    """The text as it is seen, case kept: each blank is a space, their number stays; line ends and tabs stay."""
    if text.isascii():
        return text
    text = _ignorable.sub("", text)
    kept = {ch for ch in set(text) if ord(ch) > 127 and _is_kept(ch)}
    if kept:
        parts = re.split("([" + re.escape("".join(sorted(kept))) + "])", text)
        text = "".join(p if p in kept else unicodedata.normalize("NFKD", p) for p in parts)
    else:
        text = unicodedata.normalize("NFKD", text)
    # Letters are mapped while accents are apart, so that a look-alike under an accent composes like the Latin letter.
    text = unicodedata.normalize("NFC", _ignorable.sub("", text).translate(_lookalike))
    return _blank.sub(" ", text)


def canonical_form(text: str, lookalikes: dict[int, str] = _any_lookalike) -> str:
    """For comparisons regardless of case: compatibility form, full case folding, every white space a space."""
    form = unicodedata.normalize("NFKD", _ignorable.sub("", text)).translate(lookalikes).casefold().translate(lookalikes)
    return re.sub(r"\s", " ", _ignorable.sub("", unicodedata.normalize("NFKC", form)))


def read_confusables(path: str) -> dict[int, str]:
    """``lookalikes`` of a file in the public format (source ; target ; type, in hexadecimal): single characters that pass for ASCII ones."""
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = [x.strip() for x in line.split("#")[0].split(";")]
            if len(fields) >= 2 and fields[0]:
                source, target = ("".join(chr(int(c, 16)) for c in x.split()) for x in fields[:2])
                if len(source) == 1 and not source.isascii() and target.isascii():
                    out[ord(source)] = target
    return out


def _vectorised(form, name: str):
    def apply(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts)
        forms = [form(t) for t in distinct]
        return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)

    apply.__name__ = name
    apply.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "string")


def _plain(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def canonical(text: Column, plain: bool = False) -> Column:
    """Column of ``canonical_form``; null stays null, empty stays empty. ``plain``: of ASCII texts only, null for others."""
    own = F.when(_plain(text), F.lower(F.regexp_replace(text, r"[\s\x1c-\x1f]", " ")))
    return own if plain else F.coalesce(_vectorised(canonical_form, "canonical_form")(F.when(~_plain(text), text)), own)


def visible(text: Column, plain: bool = False) -> Column:
    """Column of ``visible_form``; null stays null, empty stays empty. ``plain``: of ASCII texts only, null for others."""
    own = F.when(_plain(text), text)
    return own if plain else F.coalesce(_vectorised(visible_form, "visible_form")(F.when(~_plain(text), text)), own)


def keyed_forms(texts: DataFrame, form) -> DataFrame:
    """(kind, id, raw, form) of (kind, id, text), the hashes of each text and of its form; written once. Null ids, null and empty texts are left out.

    A text beyond ASCII is normalised once, however many rows hold it: a dictionary of the distinct ones
    (copies are combined before they are shuffled) is looked up by hash, those that many rows hold by broadcast.
    """
    rows = texts.where((F.col("text") != "") & F.col("id").isNotNull())
    digest = lambda x: F.unhex(F.sha2(x, 256))
    text = F.col("text")
    values = rows.where(~_plain(text)).select(digest(text).alias("odd"), "text").groupBy("odd").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    values = materialize(spread(values).select("odd", "n", digest(form(F.col("text"))).alias("odd_form")), "values")
    own = rows.select("kind", "id", digest(text).alias("raw"), F.when(_plain(text), digest(form(text, plain=True))).alias("form"), F.when(~_plain(text), digest(text)).alias("odd"))
    total = values.agg(F.sum("n")).first()[0] or 0
    found = lookup(own, values, ["odd"], F.col("n") >= F.lit(HOT_SHARE * total), "left")
    return materialize(found.select("kind", "id", "raw", F.coalesce("form", "odd_form").alias("form")).distinct(), "forms")


def canonical_classes(texts: DataFrame) -> DataFrame:
    """(kind, id, class_id, copies) of each row of (kind, id, text): the smallest id of the rows of its kind with the same canonical form, and how many ids those are.

    Null ids, null and empty texts have no class; rows that stand twice count once; an id with
    several texts has a row for each class.
    """
    keyed = keyed_forms(texts, canonical).select("kind", "id", "form").distinct()
    classes = keyed.groupBy("kind", "form").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    return lookup(keyed, classes, ["kind", "form"], F.col("copies") >= F.lit(HOT_SHARE * keyed.count())).select("kind", "id", "class_id", "copies")


#: Rows of one spelling that meet those of another in one place.
CELL = 1000


def same_looking_pairs(texts: DataFrame) -> DataFrame:
    """Of (kind, id, text): the pairs (kind, id_1, id_2), id_1 < id_2, whose texts look the same and aren't equal strings.

    Groups come from the hash of the visible form, without the case folding of ``canonical``,
    since case can be seen. Only hashes are shuffled. Null and empty texts have no pairs;
    copies that are equal strings make no pair with each other; an id that stands twice pairs
    like two rows would, once. Groups with one stored spelling are dropped, by a
    pre-aggregated minimum and maximum. Distinct spellings are paired first; their rows then meet in
    cells of about CELL by CELL, so a spelling that a third of all rows repeat is never in one place,
    and is never compared with its own copies.
    """
    keyed = keyed_forms(texts, visible)
    forms = keyed.groupBy("kind", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.count("*").alias("n")).where("a <> b").select("kind", "form", "n")
    total = keyed.count()
    own = materialize(lookup(keyed, forms, ["kind", "form"], F.col("n") >= F.lit(HOT_SHARE * total)).drop("n"), "several")
    spellings = own.groupBy("kind", "form", "raw").agg(F.count("*").alias("n"))
    one, two = spellings.withColumnsRenamed({"raw": "raw_1", "n": "n_1"}), spellings.withColumnsRenamed({"raw": "raw_2", "n": "n_2"})
    both = materialize(one.join(two, ["kind", "form"]).where("raw_1 < raw_2").drop("form"), "spellings")

    def side(mine: str, other: str) -> DataFrame:
        """The rows of one side of the pairs of spellings, in their row or column of cells."""
        partners = both.groupBy("kind", F.col(f"raw_{mine}").alias("raw")).agg(F.first(f"n_{mine}").alias("n"), F.collect_list(F.struct(F.col(f"raw_{other}").alias("raw"), F.col(f"n_{other}").alias("n"))).alias("with"))
        met = lookup(own.select("kind", "raw", "id"), partners, ["kind", "raw"], F.col("n") >= F.lit(HOT_SHARE * total)).select("kind", "raw", "id", F.floor(F.col("n") / CELL).alias("own"), F.explode("with").alias("w"))
        cells = met.select("kind", F.col("raw").alias(f"raw_{mine}"), F.col("w.raw").alias(f"raw_{other}"), F.col("id").alias(f"id_{mine}"), F.pmod(F.xxhash64("id"), F.col("own") + 1).alias(f"cell_{mine}"), F.sequence(F.lit(0), F.floor(F.col("w.n") / CELL)).alias("cells"))
        return cells.withColumn(f"cell_{other}", F.explode("cells")).drop("cells")

    rows = side("1", "2").join(side("2", "1"), ["kind", "raw_1", "raw_2", "cell_1", "cell_2"]).where("id_1 <> id_2")
    return rows.select("kind", F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")).distinct()
