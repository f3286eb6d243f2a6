"""Recoverable tokens: keys, the encrypted vault, and the way back."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import cell_type
from ..functions.masks import TOKENIZE, is_filled, tokenize
from ..functions.sql import name
from ..session import BROADCAST_ROWS, checkpoint, hide_keys
from .lookup import fits_broadcast, salted_lookup

# Key derivation.
PBKDF2_ROUNDS = 600_000
KEY_BYTES = 32

# Fixed value: what tokens look like; other cells need no look into a vault.
TOKEN_SHAPE = r"^(?:tok_[0-9a-f]+@masked\.local|(?:\+1-555-|XXX-XX-|TOK-CC-|Person_|TOK_)[0-9a-f]+)$"


@dataclass(frozen=True)
class VaultKey:
    """Keys derived from a password. ``salt`` is no secret and is kept with the vault."""

    salt: bytes
    cipher: str = field(repr=False)
    token: str = field(repr=False)

    @classmethod
    def derive(cls, password: str, salt: bytes | None = None, rounds: int = PBKDF2_ROUNDS) -> "VaultKey":
        if not password:
            raise ValueError("tokenising needs a password")
        salt = os.urandom(16) if salt is None else salt
        root = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, KEY_BYTES)
        return cls(salt, root.hex(), hashlib.sha256(b"token" + root).hexdigest())


def build_vault(df: DataFrame, columns: Iterable[str], key: VaultKey, token_digits: int = 24) -> DataFrame:
    """``(token, pii_type, value_enc)`` for every distinct filled cell of some columns.

    Values are made distinct, map-side first, before types and tokens are
    worked out; then each is encrypted by itself with AES-GCM.
    """
    hide_keys(df.sparkSession)
    cells = df.select(F.explode(F.array(*[F.col(name(c)).cast("string") for c in columns])).alias("v"))
    values = cells.where(F.expr(is_filled("v"))).distinct()
    typed = values.withColumn("pii_type", F.expr(f"coalesce({cell_type('v')}, 'generic')"))
    return typed.select(
        F.expr(tokenize("v", "pii_type", key.token, token_digits)).alias("token"), "pii_type",
        F.expr(f"aes_encrypt(encode(v, 'UTF-8'), unhex('{key.cipher}'), 'GCM')").alias("value_enc"))


def tokenised_columns(levels: dict[str, str]) -> list[str]:
    return [c for c, level in levels.items() if level == TOKENIZE]


def collisions(vault: DataFrame, key: VaultKey | None = None) -> DataFrame:
    """Tokens that stand for more than one value. Recovery is only safe if there are none.

    With the key, entries of one token that two runs have added for the same value count once.
    """
    value = F.lit(1) if key is None else F.expr(f"sha2(aes_decrypt(value_enc, unhex('{key.cipher}'), 'GCM'), 256)")
    per_token = vault.groupBy("token")
    if key is None:
        found = per_token.agg(F.count(value).alias("values_per_token"))
    else:  # the least and the greatest tell; a token of many entries never gathers them
        hide_keys(vault.sparkSession)
        told = vault.select("token", value.alias("v")).groupBy("token").agg(F.min("v").alias("a"), F.max("v").alias("b"))
        found = told.select("token", F.when(F.col("a") == F.col("b"), 1).otherwise(2).cast("bigint").alias("values_per_token"))
    return found.where(F.col("values_per_token") > 1)


def open_vault(vault: DataFrame, key: VaultKey) -> DataFrame:
    """``(token, value)``; an error if the password does not fit."""
    hide_keys(vault.sparkSession)
    opened = vault.select("token", F.expr(
        f"decode(try_aes_decrypt(value_enc, unhex('{key.cipher}'), 'GCM'), 'UTF-8')").alias("value"))
    probe = opened.select("value").first()
    if probe is not None and probe[0] is None:
        raise ValueError("wrong password: the vault does not open")
    return opened


def save_vault(vault: DataFrame, path: str, key: VaultKey) -> None:
    """Write a vault with its salt."""
    vault.withColumn("salt", F.lit(key.salt)).write.mode("errorifexists").parquet(path)


def load_vault(spark: SparkSession, path: str, password: str,
               rounds: int = PBKDF2_ROUNDS) -> tuple[DataFrame, VaultKey]:
    """A written vault and the key the password gives with its salt."""
    stored = spark.read.parquet(path)
    first = stored.select("salt").first()
    key = VaultKey.derive(password, bytes(first[0]) if first else b"empty", rounds)
    return stored.drop("salt"), key


def vault_key(spark: SparkSession, path: str, password: str, rounds: int = PBKDF2_ROUNDS) -> VaultKey:
    """The key of a vault, with the salt it has if it exists and is not empty; an error if the password does not fit."""
    try:
        stored, key = load_vault(spark, path, password, rounds)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return VaultKey.derive(password, rounds=rounds)
    if stored.isEmpty():
        return VaultKey.derive(password, rounds=rounds)
    open_vault(stored, key)
    return key


def extend_vault(df: DataFrame, columns: Iterable[str], path: str, key: VaultKey, token_digits: int = 24) -> int:
    """Add what is new in some columns to a vault, made if there is none. Returns the number of entries added.

    Tokens are a digest of key, type and value, so tables tokenised with one vault join on their tokens. Entries a
    vault has are found by an anti-join on tokens alone; a run that is repeated after a failure adds nothing twice. The result
    is checked: an error if a token stands for two values.
    """
    spark = df.sparkSession
    fresh = build_vault(df, columns, key, token_digits)
    try:
        known = spark.read.parquet(path).select("token")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    # the anti-join reads the vault that is written to, so what is new is written aside first
    new = checkpoint(fresh if known is None else fresh.join(known, "token", "left_anti"))
    n = new.count()
    if n or known is None:
        new.withColumn("salt", F.lit(key.salt)).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    if not collisions(whole, key).isEmpty():
        raise ValueError("two values share a token: use more token digits")
    return n


def merge_vaults(spark: SparkSession, paths: Sequence[str], password: str, target: str, rounds: int = PBKDF2_ROUNDS) -> int:
    """One vault out of several of the same password, whatever their salts; returns its entries.

    Tokens stay as they are, so every table that was tokenised with any of the vaults can be recovered with the
    new one; values are encrypted anew under one key. Equal entries count once; an error if vaults disagree on a token.
    """
    hide_keys(spark)
    key = vault_key(spark, target, password, rounds)
    opened = []
    for path in paths:
        stored, own = load_vault(spark, path, password, rounds)
        values = open_vault(stored.drop("pii_type"), own).join(stored.select("token", "pii_type"), "token")
        opened.append(values.distinct())
    union = functools.reduce(lambda a, b: a.unionByName(b), opened)
    per_token = checkpoint(union.groupBy("token").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.min("pii_type").alias("pii_type")))
    if not per_token.where("value <> other").isEmpty():
        raise ValueError("a token stands for different values in these vaults")
    sealed = per_token.select("token", "pii_type", F.expr(f"aes_encrypt(encode(value, 'UTF-8'), unhex('{key.cipher}'), 'GCM')").alias("value_enc"))
    save_vault(sealed, target, key)
    return per_token.count()


def read_single_blob_vault(spark: SparkSession, path: str, password: str, salt: bytes) -> DataFrame:
    """``(token, value)`` from a vault file that is one encrypted JSON map.

    The file is url-safe base64 of nonce, ciphertext and tag; the salt is the
    fixed one of the tool that wrote it. By its nature such a file is one row.
    """
    hide_keys(spark)
    key = VaultKey.derive(password, salt)
    blob = spark.read.text(path, wholetext=True)
    plain = F.expr(f"decode(try_aes_decrypt(unbase64(translate(trim(value), '-_', '+/')), "
                   f"unhex('{key.cipher}'), 'GCM'), 'UTF-8')")
    opened = blob.select(plain.alias("json"))
    if opened.where(F.col("json").isNull()).limit(1).count():
        raise ValueError("wrong password: the vault does not open")
    return opened.select(F.explode(F.from_json("json", "map<string,string>")).alias("token", "value"))


def recover(df: DataFrame, opened: DataFrame, columns: Sequence[str] | None = None,
            row_key: Sequence[str] | None = None, broadcast_rows: int = BROADCAST_ROWS,
            shape: str | None = TOKEN_SHAPE) -> DataFrame:
    """Replace every cell that is a token by its value; all other cells stay.

    By default every string column is looked at. The added ``recovered_cells``
    counts the replacements of a row. A vault too large to broadcast is joined once, to narrow
    cells of all columns, whose values come back to the rows by ``row_key``. The key
    must tell rows apart, NULLs included, or it is an error; without one
    rows are numbered and written to the shared folder first. Only cells of the ``shape`` of tokens are
    shuffled then; a vault of other tokens needs another shape, or None.
    """
    columns = list(columns or [f.name for f in df.schema.fields
                               if f.dataType.simpleString() == "string" and f.name not in (row_key or ())])
    if row_key and df.groupBy(*row_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"rows share a key: {', '.join(row_key)}")
    if not fits_broadcast(opened, broadcast_rows):
        if row_key:
            return _recover_by_cells(df, opened, columns, list(row_key), shape)
        numbered = checkpoint(df.withColumn("_row", F.monotonically_increasing_id()))
        return _recover_by_cells(numbered, opened, columns, ["_row"], shape).drop("_row")
    out = df.withColumn("recovered_cells", F.lit(0))
    for c in columns:
        table = opened.select(F.col("token").alias(c), F.col("value").alias("_value"))
        out = out.join(F.broadcast(table), c, "left")
        out = out.withColumns({
            c: F.coalesce("_value", F.col(name(c))),
            "recovered_cells": F.col("recovered_cells") + F.col("_value").isNotNull().cast("int"),
        }).drop("_value")
    return out.select(*df.columns, "recovered_cells")


def _recover_by_cells(df: DataFrame, opened: DataFrame, columns: list[str], row_key: list[str], shape: str | None) -> DataFrame:
    keys = [f"_key{i}" for i in range(len(row_key))]
    named = [F.col(name(c)).alias(k) for c, k in zip(row_key, keys)]
    cells = df.select(*named, F.posexplode(F.array(*[F.col(name(c)) for c in columns])).alias("_at", "token"))
    cells = cells.where(F.col("token").rlike(shape) if shape else F.col("token").isNotNull())
    found = salted_lookup(cells, opened, "token", spread_by=[*keys, "_at"]) \
        .where(F.col("value").isNotNull())
    # a row has as many entries as it has columns, so these maps stay small
    values = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_at", "value"))).alias("_values"))
    same = functools.reduce(lambda a, b: a & b, (F.col(name(c)).eqNullSafe(F.col(k)) for c, k in zip(row_key, keys)))
    joined = df.join(values, same, "left")
    restored = {c: F.coalesce(F.try_element_at("_values", F.lit(i)), F.col(name(c)))
                for i, c in enumerate(columns)}
    return joined.select(*[restored.get(c, F.col(name(c))).alias(c) for c in df.columns],
                         F.coalesce(F.size("_values"), F.lit(0)).alias("recovered_cells"))


def recovered_total(recovered: DataFrame) -> DataFrame:
    """One row: rows and recovered cells."""
    return recovered.agg(F.count(F.lit(1)).alias("total_rows"),
                         F.coalesce(F.sum("recovered_cells"), F.lit(0)).alias("recovered_cells"))
