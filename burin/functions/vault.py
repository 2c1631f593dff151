"""The encrypted container: recognising and validating its header, in the JVM.

The container's own cipher needs Argon2id and XChaCha20, which no library here has, so it
can be recognised and checked but not opened. seal() and unseal() encrypt columns with
Spark's AES-GCM instead; they are NOT compatible with the container.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The header's size, and the limits that a header may state.
HEADER_BYTES, VERSION, MOST_OPERATIONS = 54, 1, 10
LEAST_MEMORY, MOST_MEMORY = 8 << 20, 1 << 30


def is_container(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"ADEI")


def _number(content: Column, at: int, size: int) -> Column:
    """A little-endian integer at a place from 0."""
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k + 1, 1)), 16, 10).cast("long")
    return sum((byte(k) * (1 << 8 * k) for k in range(1, size)), byte(0))


def header(content: Column) -> Column:
    """struct(version, algorithm, operations, memory, salt, nonce, error) of a container."""
    version, operations, memory = _number(content, 4, 1), _number(content, 6, 4), _number(content, 10, 4)
    error = (
        F.when(~is_container(content), "No es un contenedor cifrado").when(F.octet_length(content) < HEADER_BYTES, "El archivo está dañado")
        .when(version != VERSION, "Versión no admitida").when(~operations.between(1, MOST_OPERATIONS) | ~memory.between(LEAST_MEMORY, MOST_MEMORY), "El archivo está dañado")
    )
    salt, nonce = F.hex(F.substring(content, 15, 16)), F.hex(F.substring(content, 31, 24))
    return F.struct(version.alias("version"), _number(content, 5, 1).alias("algorithm"), operations.alias("operations"), memory.alias("memory"), salt.alias("salt"), nonce.alias("nonce"), error.alias("error"))


def _key(passphrase: Column) -> Column:
    return F.unhex(F.sha2(passphrase.cast("binary"), 256))


def seal(content: Column, passphrase: Column) -> Column:
    """AES-GCM with a key from the passphrase's hash; not the container's format."""
    return F.aes_encrypt(content, _key(passphrase), F.lit("GCM"))


def unseal(content: Column, passphrase: Column) -> Column:
    """What seal() encrypted; null for another passphrase or damaged bytes."""
    return F.try_aes_decrypt(content, _key(passphrase), F.lit("GCM"))
