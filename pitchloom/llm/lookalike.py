"""Texts that look the same but differ in their characters, brought to one form.

Every look-alike is mapped in one pass over the text: compatibility forms that are drawn like
their base (all widths, mathematical letters, ligatures, positional forms), letters of other
scripts that look like Latin ones, odd spaces and dashes, and characters that are drawn as
nothing. The mapped values are then grouped under the accent-sensitive UNICODE collation in
SQL, which makes composed and decomposed accents equal. One member of each class, chosen by
rule, is its canonical form and is joined back.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.session import cut

COLLATION = "UNICODE"

# --- fixed values: letters of other scripts that look like a Latin letter ---
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝүӏ"
CYRILLIC_LOOKS_LIKE = "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwyl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳνͿ"
GREEK_LOOKS_LIKE = "ABEZHIKMNOPTYXojvJ"
OTHER = "օհոսցԼՕՏɡɑ"
OTHER_LOOKS_LIKE = "ohnugLOSga"
#: kinds of compatibility forms that are drawn like what they stand for; raised, lowered, circled, squared and fractional ones aren't
DRAWN_ALIKE = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>"}
#: of kind <compat>, but drawn differently: the long s, the Greek variant letters, kip, per cent-like signs
DRAWN_APART = "ſﬅϐϑϒϓϔϕϖϰϱϲϴϵ℀℁℅℆№"
DASHES = "‐‑‒−﹣－˗"
QUOTES = {"ʼ": "’", "ʹ": "′"}
#: drawn as nothing, though not of category Cf: joiners, fillers, variation selectors
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# --- end of fixed values ---


@cache
def look_alike_table() -> dict[int, str]:
    """What each mapped code point becomes; by rule over all of Unicode, see ``DRAWN_ALIKE``."""
    letters = dict(zip(CYRILLIC + GREEK + OTHER, CYRILLIC_LOOKS_LIKE + GREEK_LOOKS_LIKE + OTHER_LOOKS_LIKE))
    letters |= QUOTES | dict.fromkeys(DASHES, "-")
    table: dict[int, str] = dict.fromkeys(INVISIBLE, "")
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if code in table or kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf":
            table[code] = ""  # direction marks, joiners, soft hyphens, tags
        elif kind == "Zs":
            table[code] = " "
        elif c in letters:
            table[code] = letters[c]
        elif (parts := unicodedata.decomposition(c)) and parts.startswith("<"):
            form = _unfold(c)
            # a space with a mark is an accent drawn alone, nothing to compare with
            if form != c and not (form[0] == " " and len(form) > 1):
                table[code] = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in form))
        elif (form := unicodedata.normalize("NFD", c))[0] in letters and len(form) > 1:
            # a composed letter is mapped as its base letter and marks would be
            table[code] = unicodedata.normalize("NFC", letters[form[0]] + form[1:])
    return {a: b for a, b in table.items() if b != chr(a)}


def _unfold(c: str) -> str:
    """The characters that ``c`` is drawn like, decompositions followed to their end."""
    parts = unicodedata.decomposition(c).split()
    if not parts or (parts[0].startswith("<") and parts[0] not in DRAWN_ALIKE) or c in DRAWN_APART:
        return c
    if not parts[0].startswith("<"):
        return c  # canonical ones are the collation's business
    return "".join(_unfold(chr(int(x, 16))) for x in parts[1:])


class _Rest(dict):
    """A table for ``str.translate`` that works out what isn't in it once and keeps it."""

    def __init__(self, table: dict, rest) -> None:
        super().__init__(table)
        self.rest = rest

    def __missing__(self, code: int):
        self[code] = out = self.rest(chr(code))
        return out


@cache
def _mapping() -> tuple[frozenset[str], _Rest]:
    return frozenset(map(chr, look_alike_table())), _Rest(look_alike_table(), lambda c: c)


@cache
def _core() -> _Rest:
    """Decomposed, without marks and without what a collation may ignore."""
    keep = lambda c: c if c.isprintable() and not unicodedata.combining(c) and ord(c) < 0x500 else ""
    return _Rest({}, lambda c: "".join(map(keep, unicodedata.normalize("NFD", c))))


def look_alike(text: str) -> str:
    """The text with every look-alike mapped; accents, case, digits and punctuation stay."""
    mapped, table = _mapping()
    return text if text.isascii() or mapped.isdisjoint(text) else text.translate(table)


def coarse(form: str) -> str:
    """The same for all values that are equal under the collation: the decomposed form without
    marks and without characters that a collation may ignore."""
    return form if form.isascii() and form.isprintable() else form.translate(_core())


def _hashes(text: str) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, h, a, b): coarse hash of the mapped text, exact hash of the text in two halves."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        exact = [_hashes(t) for t in texts]
        h = [_hashes(coarse(look_alike(t)))[0] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array([x for x, _ in exact], pa.int64()), pa.array([x for _, x in exact], pa.int64())], names=["_key", "_h", "_a", "_b"])


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text) to (a, b, text, form, n): the mapped text and how many characters of the text are mapped."""
    mapped, _ = _mapping()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        odd = [0 if t.isascii() else sum(c in mapped for c in t) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([look_alike(t) for t in texts], pa.string()), pa.array(odd, pa.int64())], names=["_a", "_b", "_text", "_plain", "_odd"])


def members(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The classes of different texts that look alike, each text once: ((key, a, b) of all rows
    that may be in one, (a, b, text, class_no, canonical) of the texts of the classes).

    a and b are the two halves of a text's 128-bit hash, ``class_no`` the smallest of them
    in the class. The texts are mapped and hashed in one pass; they are shuffled only where
    two different ones have the same coarse hash, and then once per text, however many rows
    hold it. ``canonical`` is a text that the mapping leaves as it is, if there is one, else
    the one with the fewest mapped characters (then the shortest, then the smallest in code
    point order).
    """
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = dict((f.name, f.dataType.simpleString()) for f in rows.schema.fields)["_key"]
    # keys and hashes only, so that no later step maps the texts again
    hashed = cut(rows.mapInArrow(_digest, f"_key {kind}, _h long, _a long, _b long"))
    # copies meet before the classes do, so a text in a third of all rows is one row here
    held = hashed.groupBy("_h", "_a", "_b").agg(F.min("_key").alias("_key"))
    several = held.groupBy("_h").agg(F.min(F.struct("_a", "_b")).alias("lo"), F.max(F.struct("_a", "_b")).alias("hi")).where("lo <> hi").select("_h")
    some = held.join(several, "_h", "left_semi")
    texts = some.select("_key", "_a", "_b").join(rows, "_key").select("_a", "_b", "_text").dropDuplicates(["_a", "_b"])
    mapped = texts.mapInArrow(_map, "_a long, _b long, _text string, _plain string, _odd long").withColumn("_form", F.collate("_plain", COLLATION))
    best = F.min(F.struct((F.col("_odd") > 0).alias("odd"), F.col("_odd").alias("n"), F.length("_text").alias("size"), F.col("_text").alias("text")))
    grouped = mapped.groupBy("_form").agg(best.alias("best"), F.min(F.struct("_a", "_b")).alias("class_no"), F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1")
    classes_ = mapped.join(grouped, "_form").select("_a", "_b", "_text", "class_no", F.col("best.text").alias("canonical"))
    return hashed.join(several, "_h", "left_semi").select("_key", "_a", "_b"), cut(classes_)


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, class_id, canonical) for rows whose look-alike class holds several texts.

    ``class_id`` is the smallest key of the class; for ``canonical`` see ``members``. Every
    other text is its own canonical form, see ``canonical_text``. Rows with a null text or
    key belong to no class; empty texts are texts. Extra columns are left out, whatever
    their names; an empty table gives no rows.
    """
    rows, texts = members(df, key, text)
    rows = rows.join(texts, ["_a", "_b"])
    least = rows.groupBy("class_no").agg(F.min("_key").alias("class_id"))
    return rows.join(least, "class_no").select(F.col("_key").alias(key), F.col("_text").alias(text), "class_id", "canonical")


def class_sizes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, n_rows, n_texts, n_links): links are the pairs of rows whose texts differ."""
    rows, texts = members(df, key, text)
    per = rows.join(texts.select("_a", "_b", "class_no"), ["_a", "_b"]).groupBy("class_no", "_a", "_b").agg(F.min("_key").alias("k"), F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return per.groupBy("class_no").agg(F.min("k").alias("class_id"), n.alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), ((n * n - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("n_links")).drop("class_no")


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical) for every row: the class's canonical member joined back to those
    rows whose text has look-alikes, the text itself for all others (null stays null)."""
    rows, texts = members(df, key, text)
    found = rows.join(texts.where(F.col("_text") != F.col("canonical")).select("_a", "_b", "canonical"), ["_a", "_b"]).select(F.col("_key").alias("_k"), "canonical").dropDuplicates(["_k"])
    rows = df.select(F.col(key).alias(key), F.col(text).alias("_t"))
    return rows.join(found, rows[key] == found["_k"], "left").select(key, F.coalesce("canonical", "_t").alias("canonical"))


def alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), the smaller first: rows of one class whose texts differ.

    The pairs are made between the different texts of a class and then of their rows, so
    copies of one text never meet each other; no text is in a join, only hashes.
    """
    rows, texts = members(df, key, text)
    texts = texts.select("class_no", "_a", "_b")
    other = texts.withColumnsRenamed({"_a": "_a2", "_b": "_b2"})
    apart = texts.join(other, "class_no").where(F.struct("_a", "_b") < F.struct("_a2", "_b2")).select("_a", "_b", "_a2", "_b2")
    left, right = rows.withColumnRenamed("_key", "_k"), rows.select(F.col("_key").alias("_k2"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
    pairs = apart.join(left, ["_a", "_b"]).join(right, ["_a2", "_b2"]).where(F.col("_k") != F.col("_k2"))
    return pairs.select(F.least("_k", "_k2").alias(f"{key}_a"), F.greatest("_k", "_k2").alias(f"{key}_b")).distinct()
