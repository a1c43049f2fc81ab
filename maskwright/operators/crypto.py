"""Encrypted maps: AES-GCM by the JVM's own functions.

A key is broadcast and comes into the plan as the result of a function, so that neither plans nor event logs show it.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.runtime import once

IV_BYTES, TAG_BYTES, KEY_BYTES, SALT_BYTES, ROUNDS = 12, 16, 32, 16, 100_000


def generate_key() -> bytes:
    return os.urandom(KEY_BYTES)


def generate_salt() -> bytes:
    return os.urandom(SALT_BYTES)


def derive_key(password: str, salt: bytes, rounds: int = ROUNDS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, KEY_BYTES)


def valid_key(key: bytes) -> bool:
    return len(key) == KEY_BYTES


def same_secret(a: bytes, b: bytes) -> bool:
    return hmac.compare_digest(a, b)


class KeyProvider(Protocol):
    def key(self) -> bytes: ...


class MemoryKey:
    """A key held in the driver's memory."""

    def __init__(self, key: bytes | None = None):
        self._key = key or generate_key()

    def key(self) -> bytes:
        return self._key

    def rotate(self) -> bytes:
        old, self._key = self._key, generate_key()
        return old


class ConfiguredKey:
    """A key from configuration, in base64."""

    def __init__(self, text: str):
        self._key = base64.b64decode(text)
        if not valid_key(self._key):
            raise ValueError(f"the key must have {KEY_BYTES} bytes")

    def key(self) -> bytes:
        return self._key


def key_column(key: bytes | KeyProvider) -> Column:
    """The key as a column; its bytes reach the tasks by a broadcast."""
    secret = key if isinstance(key, bytes) else key.key()
    if not valid_key(secret):
        raise ValueError(f"the key must have {KEY_BYTES} bytes")
    shared = SparkSession.active().sparkContext.broadcast(secret)

    @once
    @F.arrow_udf(T.BinaryType())
    def held(rows: pa.Array) -> pa.Array:
        return pa.array([shared.value] * len(rows), pa.binary())

    return held(F.lit(True))


def encrypt_map(originals: Column, key: Column | bytes | KeyProvider) -> Column:
    """Struct of ciphertext, iv and auth_tag, all base64; null for null."""
    secret = key if isinstance(key, Column) else key_column(key)
    # A nonce of its own that the optimiser knows to be random: what reads a part of the struct must not seal again.
    nonce = F.substring(F.unhex(F.sha2(F.uuid(), 256)), 1, IV_BYTES)
    sealed = F.aes_encrypt(F.encode(F.to_json(originals), "UTF-8"), secret, F.lit("GCM"), F.lit("DEFAULT"), nonce)
    parts = F.transform(F.array(sealed), lambda b: F.struct(F.base64(F.substring(b, IV_BYTES + 1, F.length(b) - IV_BYTES - TAG_BYTES)).alias("ciphertext"), F.base64(F.substring(b, 1, IV_BYTES)).alias("iv"), F.base64(F.substring(b, F.length(b) - TAG_BYTES + 1, TAG_BYTES)).alias("auth_tag")))
    return F.when(originals.isNotNull(), F.element_at(parts, 1))


def decrypt_map(sealed: Column, key: Column | bytes | KeyProvider) -> Column:
    """The map of an encrypted struct; null for a wrong key or altered bytes."""
    secret = key if isinstance(key, Column) else key_column(key)
    whole = F.concat(F.unbase64(sealed.iv), F.unbase64(sealed.ciphertext), F.unbase64(sealed.auth_tag))
    return F.from_json(F.decode(F.try_aes_decrypt(whole, secret, F.lit("GCM")), "UTF-8"), "map<string,string>")
