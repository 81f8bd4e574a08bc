"""Pseudonyms and masks as native expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from . import fixed
from .sql import case
from .text import strip, text_value


def _bytes(value: bytes) -> str:
    return f"X'{value.hex()}'"


@dataclass(frozen=True)
class Pseudonymizer:
    """Keyed, stable tokens: HMAC-SHA256 of organisation, field and value.

    The two HMAC pads are computed on the driver and are equivalent to the key:
    take the key from a secret store and keep query plans out of shared logs.
    """

    secret_key: str = field(repr=False)
    org_id: str

    def __post_init__(self):
        if not self.secret_key or len(self.secret_key) < fixed.MIN_KEY_LENGTH:
            raise ValueError(
                "La clave de seudonimización debe tener al menos "
                f"{fixed.MIN_KEY_LENGTH} caracteres.")

    def _pad(self, byte: int) -> bytes:
        key = self.secret_key.encode()
        key = hashlib.sha256(key).digest() if len(key) > 64 else key
        return bytes(b ^ byte for b in key.ljust(64, b"\0"))

    def token(self, e: str, name: str = "", dtype=None) -> str:
        """Token of a cell: null and empty give ''. Depends on the field name too."""
        text = f"lower({strip(text_value(e, dtype))})"
        scope = self.org_id.encode() + b"\0" + name.encode() + b"\0"
        inner = f"sha2(concat({_bytes(self._pad(0x36) + scope)}, CAST({text} AS BINARY)), 256)"
        outer = f"sha2(concat({_bytes(self._pad(0x5C))}, unhex({inner})), 256)"
        return case((f"{text} = ''", "''"),
                    default=f"substring({outer}, 1, {fixed.TOKEN_LENGTH})")


def mask_email(e: str) -> str:
    """First and last letter of the mailbox and the whole domain stay visible."""
    shown = strip(f"coalesce({e}, '')")
    domain = f"substring_index({shown}, '@', -1)"
    size = f"(length({shown}) - length({domain}) - 1)"
    box = f"substring({shown}, 1, {size})"
    hidden = case(
        (f"{size} <= 2", f"repeat('*', {size})"),
        default=f"concat(substring({box}, 1, 1), repeat('*', {size} - 2), substring({box}, -1, 1))")
    return case((f"NOT contains({shown}, '@')", "'***'"),
                default=f"concat({hidden}, '@', {domain})")


def _stars_but_last(text: str, visible: int) -> str:
    return case(
        (f"length({text}) < 4", "repeat('*', 9)"),
        default=f"concat(repeat('*', length({text}) - {visible}), substring({text}, -{visible}))")


def mask_phone(e: str) -> str:
    return _stars_but_last(f"regexp_replace(coalesce({e}, ''), '[^0-9]', '')", 3)


def mask_tax_id(e: str) -> str:
    return _stars_but_last(f"upper({strip(f"coalesce({e}, '')")})", 4)


MASKS = {"email": mask_email, "phone": mask_phone, "tax_id": mask_tax_id, "iban": mask_tax_id}
