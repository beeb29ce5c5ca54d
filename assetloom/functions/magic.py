"""File formats by leading bytes, and names that tell another format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetloom.functions.paths import parent, stem

# Signatures, brands of the HEIF family, and other extensions of the same format.
SIGNATURES = (("jpg", "FFD8FF"), ("png", "89504E47"), ("gif", "47494638"))
HEIF_BRANDS = ("ftyp", "heic", "heif", "mif1")
ALIASES = {"jpg": ("jpg", "jpeg", "jpe", "jfif"), "heic": ("heic", "heif")}
#: What the extension check looks at.
CANDIDATES = ("jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "tif", "tiff")


def is_heic(content: Column) -> Column:
    """Twelve bytes or more, and a brand of the family at byte 4; any file with an ftyp box passes."""
    return (F.octet_length(content) >= 12) & F.substring(F.hex(content), 9, 8).isin(*[b.encode().hex().upper() for b in HEIF_BRANDS])


def format_by_magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.octet_length(content) < 12, F.lit(None).cast("string")).when(is_heic(F.substring(content, 1, 12)), "heic")
    for name, code in SIGNATURES:
        out = out.when(head.startswith(code), name)
    return out.when(head.startswith(b"RIFF".hex().upper()) & head.endswith(b"WEBP".hex().upper()), "webp")


def extension_matches(ext: Column, format_: Column) -> Column:
    low = F.lower(ext)
    out = low == format_
    for name, known in ALIASES.items():
        out = out | ((format_ == name) & low.isin(*known))
    return F.coalesce(out, F.lit(False))


def corrected(path: Column, format_: Column) -> Column:
    """parent/stem.format"""
    above = parent(path)
    return F.concat(F.when(path.contains("/"), F.concat(above, F.lit("/"))).otherwise(""), stem(path), F.lit("."), format_)
