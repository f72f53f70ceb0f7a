"""Column encryption and keyed Bloom encodings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypt(col: Column, key: bytes) -> Column:
    """AES-GCM with a fresh nonce per value, as base64 text. Null stays null."""
    return F.base64(F.aes_encrypt(col.cast("string"), F.lit(key), F.lit("GCM")))


def decrypt(col: Column, key: bytes, strict: bool = True) -> Column:
    """Inverse of :func:`encrypt`; ``strict=False`` turns unreadable values into null."""
    reader = F.aes_decrypt if strict else F.try_aes_decrypt
    return reader(F.unbase64(col), F.lit(key), F.lit("GCM")).cast("string")


def encrypt_columns(df: DataFrame, cols: list[str], key: bytes) -> DataFrame:
    return df.withColumns({c: encrypt(F.col(c), key) for c in cols if c in df.columns})


def decrypt_columns(df: DataFrame, cols: list[str], key: bytes, strict: bool = True) -> DataFrame:
    return df.withColumns({c: decrypt(F.col(c), key, strict) for c in cols if c in df.columns})


@dataclass(frozen=True)
class ClkField:
    """One encoded field: text by bigrams, or digits by position."""

    name: str
    kind: str = "text"
    sentinel: str | None = None


def clk_tokens(field: ClkField, col: Column) -> Column:
    """Padded bigrams for text, ``position character`` for digits; missing or sentinel gives none."""
    text = col.cast("string")
    if field.kind == "text":
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        grams = F.transform(
            F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))
        )
    else:
        grams = F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.concat_ws(" ", i.cast("string"), F.substr(text, i, F.lit(1))),
        )
    empty = F.array().cast("array<string>")
    missing = text.isNull() | (F.length(text) == 0)
    if field.sentinel is not None:
        missing = missing | (text == field.sentinel)
    return F.when(missing, empty).otherwise(F.array_distinct(grams))


def clk_encode(
    df: DataFrame,
    fields: list[ClkField],
    secret: str,
    bits: int = 1024,
    bits_per_field: int = 300,
    out: str = "clk",
) -> DataFrame:
    """Adds the sorted set bits of a keyed Bloom filter over ``fields``.

    Each field spends about ``bits_per_field`` hash bits, shared evenly over its tokens. One SHA-256
    of secret, field and token gives two numbers h and g; round k sets bit (h + k·g) mod ``bits``.
    """

    def number(digest: Column, at: int) -> Column:
        return F.conv(F.substr(digest, F.lit(at), F.lit(7)), 16, 10).cast("long")

    def tokens(f: ClkField) -> Column:
        return F.col(f"_tokens_{f.name}")

    def rounds(f: ClkField) -> Column:
        share = F.round(F.lit(bits_per_field) / F.greatest(F.size(tokens(f)), F.lit(1)))
        return F.greatest(F.lit(1), share.cast("int"))

    def seeds(f: ClkField) -> Column:
        hashed = F.transform(
            tokens(f), lambda t: F.sha2(F.concat_ws("|", F.lit(secret), F.lit(f.name), t), 256)
        )
        return F.transform(hashed, lambda s: F.struct(number(s, 1).alias("h"), number(s, 8).alias("g")))

    def field_bits(f: ClkField) -> Column:
        steps = F.col(f"_steps_{f.name}")
        return F.flatten(
            F.transform(
                F.col(f"_seeds_{f.name}"),
                lambda seed: F.transform(steps, lambda k: ((seed["h"] + k * seed["g"]) % bits).cast("int")),
            )
        )

    # each part is a column of its own, so that none is evaluated again inside a lambda
    parts = df.withColumns({f"_tokens_{f.name}": clk_tokens(f, F.col(f.name)) for f in fields})
    parts = parts.withColumns(
        {f"_steps_{f.name}": F.sequence(F.lit(1), rounds(f)) for f in fields}
        | {f"_seeds_{f.name}": seeds(f) for f in fields}
    )
    every = F.sort_array(F.array_distinct(F.concat(*[field_bits(f) for f in fields])))
    return parts.select(*df.columns, every.alias(out))


def dice(a: Column, b: Column) -> Column:
    """Overlap of two encodings: 2·shared / (set bits of both)."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total)
