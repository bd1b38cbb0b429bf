"""One form for texts that look the same.

`normal_form` maps letters of the same shape to one, composes under compatibility, folds case in full, makes all
blanks one and removes default-ignorable characters. Texts that look the same have the same normal form, and so
have some that a reader tells apart: by letter case, raised digits, `…` against three stops. The normal form is
therefore the key that brings texts together, and the form of *looks*, which keeps what shows, decides among them:
only the compatibility mappings that do not change the look (width, ligatures, positional forms, blanks) apply.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from paperweir.llm.runs import binary
from paperweir.operators.skew import salted_join
from paperweir.session import cut, drop_cut

# Letters of other scripts that have the shape of a Latin letter, and that letter, from the public table of
# confusable characters. Left out are those that a reader tells apart (letters against digits, capitals against small
# ones, a missing dot, bold and slanted letters).
SAME_SHAPE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜѴаеорсухѕіјһԁԛԝӏѵү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹϺονρυκϲϳ" + "օՍՏՕհոսց" + "ɡᴄᴏᴠᴡᴢ" + "ЁЇёї" + "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" + "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ" + "ⲞⲢⲤⲦⲬⲘⲚⲎⲔⲂⲀⲈⲓⲟⲣⲥ",
        "ABESIJKMHOPCTYXYGQWVaeopcyxsijhdqwlvy" + "ABEZHIKMNOPTYXJCMovpukcj" + "oUSOhnug" + "gcovwz" + "ËÏëï" + "ABCDEHJKLMPRSTVWZ" + "ABCDEFGHIJKLMNOPRSTUVWXYZ" + "OPCTXMNHKBAEiopc",
        strict=True,
    )
)
# Default-ignorable characters (Unicode property), as ranges of code points.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
#: Kinds of compatibility mapping that leave the look of a character as it is.
UNSEEN = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


@lru_cache(maxsize=1)
def _ignorable() -> dict[int, None]:
    return {c: None for a, b in IGNORABLE for c in range(a, b + 1)}


@lru_cache(maxsize=1)
def looks_table() -> dict[int, str | None]:
    """What each character becomes before composition; built from the rule, not listed."""
    out: dict[int, str | None] = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        kind = unicodedata.decomposition(ch).split(" ", 1)[0]
        if unicodedata.category(ch) == "Zs":
            out[c] = " "
        elif kind in UNSEEN or kind == "<compat>" and (0xFB00 <= c <= 0xFB4F or 0x2160 <= c <= 0x217F or 0x132 <= c <= 0x133 or 0x1C4 <= c <= 0x1CC or 0x1F1 <= c <= 0x1F3):
            out[c] = unicodedata.normalize("NFKC", ch)
    out |= {ord(a): b for a, b in SAME_SHAPE.items()} | _ignorable()
    for c, v in list(out.items()):  # full-width forms and the like may map to a letter that has a twin itself
        if v and v in SAME_SHAPE:
            out[c] = SAME_SHAPE[v]
    return out


_JOINED = re.compile("(?<=[←-⯿\U0001f000-\U0001faff️])‍(?=[←-⯿\U0001f000-\U0001faff])")


def looks(text: str) -> str:
    """The form in which texts that look the same are equal. A joiner between two pictures shows, so it stays."""
    if text.isascii():
        return text
    if "‍" in text:
        text = _JOINED.sub("", text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(looks_table()))


_BLANKS = re.compile(r"[^\S\n]+")


@lru_cache(maxsize=1)
def _shapes() -> dict[int, str | None]:
    return {ord(a): b for a, b in SAME_SHAPE.items()} | _ignorable()


def folded(text: str) -> str:
    """Shapes mapped, NFKC with full case folding, runs of blanks as one space, line breaks kept, ignorable characters gone."""
    if text.isascii():
        return _BLANKS.sub(" ", text.replace("\r\n", "\n").casefold()).strip()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).translate(_shapes()))
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", text).translate(_shapes()).casefold())
    return _BLANKS.sub(" ", text.replace("\r\n", "\n")).strip()


@pandas_udf(StringType())
def _folded(col):
    known = {t: folded(t) for t in col.dropna().unique()}
    return pd.Series([known[t] if isinstance(t, str) else None for t in col], dtype=object)


def normal_form(text: Column | str) -> Column:
    """The folded form of a text column, worked out once for each distinct value of a batch; null stays null."""
    return _folded(F.col(text) if isinstance(text, str) else text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, and the digests of normal form, look and text, each worked out once for a distinct text of a batch."""

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    for batch in batches:
        values = batch.column(1).dictionary_encode()
        each = []
        for t in values.dictionary.to_pylist():
            d, form = digest(t), looks(t)
            each.append((digest(folded(t)), d if form == t else digest(form), d))
        at = values.indices.to_numpy()
        block, look, text = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, 16)[at] for x in zip(*each)) if each else (np.empty((0, 16), np.uint8),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), binary(block), binary(look), binary(text)], ["key", "block", "look", "text"])


def _groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows `key, look, text` of looks that several texts share; a written table.

    The normal form brings texts together: blocks of one text end there, of the others the look decides.
    """
    rows = df.select(F.col(key).cast("string"), F.col(text).cast("string")).dropna()
    rows = rows.mapInArrow(_digests, "key string, block binary, look binary, text binary").distinct()
    rows = cut(rows, "looks")
    kinds = rows.groupBy("block", "look", "text").agg(F.count("*").alias("n"))
    blocks = cut(kinds.groupBy("block").agg(F.count("*").alias("texts")).where("texts > 1").select("block"), "blocks")
    near = rows.join(blocks, "block", "left_semi")
    shared = near.groupBy("look", "text").agg(F.count("*").alias("n")).groupBy("look").agg(F.count("*").alias("texts")).where("texts > 1").select("look")
    out = cut(near.join(shared, "look", "left_semi").select("key", "look", "text"), "groups")
    drop_cut(rows)
    drop_cut(blocks)
    return out


def lookalikes(df: DataFrame, key: str, text: str, salt_rows: int = 20_000) -> DataFrame:
    """Pairs of keys `key_a < key_b` whose texts look the same but differ in a code point; each pair once.

    Rows with a null key or text are left out; repeated rows, empty tables and further columns change nothing.
    Texts travel as digests of 16 bytes. Variants of one look are paired first and then expanded to their keys;
    the keys of a variant with many copies are spread over salts, against each of which the other side is laid,
    so no task holds a whole group. Equal texts are never paired. `look_classes` says the same in a row for each key.
    """
    rows = _groups(df, key, text)
    of_several = rows.groupBy("look", "text").agg(F.count("*").alias("n"))
    a = of_several.select("look", F.col("text").alias("ta"), F.col("n").alias("na"))
    b = of_several.select("look", F.col("text").alias("tb"), F.col("n").alias("nb"))
    # the variant with more keys is the salted side
    pairs = a.join(b, "look").where((F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ta") < F.col("tb")))
    pairs = pairs.select("look", "ta", "tb", F.ceil(F.col("na") / salt_rows).alias("salts"))
    many = rows.select("look", F.col("text").alias("ta"), F.col("key").alias("x"))
    few = rows.select("look", F.col("text").alias("tb"), F.col("key").alias("y"))
    left = salted_join(many, pairs, ["look", "ta"]).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")))
    right = few.join(pairs, ["look", "tb"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("look", "ta", "tb", "salt", "y")
    met = left.select("look", "ta", "tb", "salt", "x").join(right, ["look", "ta", "tb", "salt"]).where("x <> y")
    return met.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each key whose text has variants that look the same: `key, class_key, n_texts, n_keys`.

    `class_key` is the least key of the class, `n_texts` the number of its variants, `n_keys` of its keys. The number of
    rows grows with the keys, not with the pairs. Nulls, repeated rows and empty tables are as in `lookalikes`.
    """
    rows = _groups(df, key, text)
    variants = rows.groupBy("look", "text").agg(F.min("key").alias("least"))
    keys = rows.select("look", "key").distinct().groupBy("look").agg(F.count("*").alias("n_keys"))
    classes = variants.groupBy("look").agg(F.min("least").alias("class_key"), F.count("*").alias("n_texts")).join(keys, "look")
    return salted_join(rows.select("look", "key").distinct(), classes, ["look"]).select("key", "class_key", "n_texts", "n_keys").distinct()
