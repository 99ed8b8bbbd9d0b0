"""A ring of encryption keys: one is active, all of them decrypt.

A ciphertext names its key, so text sealed before a rotation stays readable and
can be sealed anew in one projection. The ring is held by the driver; its keys, a few,
go into the plan as literals.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import redaction


@dataclass
class Key:
    name: str
    secret: bytes = field(repr=False)
    created: datetime
    expires: datetime | None = None


class KeyRing:
    """Keys by name; the newest is active until it expires or is rotated out."""

    def __init__(self, max_age_days: int | None = 90):
        self.max_age_days, self.keys, self._active = max_age_days, {}, None

    def add(self, secret: bytes, name: str | None = None, now: datetime | None = None) -> Key:
        if len(secret) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        now = now or datetime.now(UTC)
        name = name or os.urandom(8).hex()
        if ":" in name or name in self.keys:
            raise ValueError(f"no fit name for a new key: {name}")
        expires = now + timedelta(days=self.max_age_days) if self.max_age_days else None
        self.keys[name] = Key(name, secret, now, expires)
        self._active = name
        return self.keys[name]

    def rotate(self, now: datetime | None = None) -> Key:
        """A new random key, active from now on."""
        return self.add(os.urandom(32), now=now)

    def from_password(self, password: str, salt: bytes | None = None) -> tuple[Key, bytes]:
        """A key derived from a password; the salt is to be kept."""
        salt = salt or os.urandom(16)
        return self.add(redaction.derive_key(password, salt)), salt

    def active(self, now: datetime | None = None) -> Key:
        """The active key; an expired one is rotated, and a ring without any gets one."""
        key = self.keys.get(self._active)
        if key is None or (key.expires and key.expires <= (now or datetime.now(UTC))):
            key = self.rotate(now)
        return key

    def drop(self, name: str) -> None:
        """Forgets a key that isn't active; what it sealed is lost."""
        if name == self._active:
            raise ValueError("the active key can't be dropped")
        del self.keys[name]

    def encrypt(self, text: Column) -> Column:
        """name:ciphertext by the active key; null stays null."""
        key = self.active()
        return F.concat(F.lit(f"{key.name}:"), redaction.encrypt(text, F.lit(key.secret)))

    def decrypt(self, sealed: Column) -> Column:
        """The text, or null where the key is unknown or the ciphertext damaged."""
        name, body = F.substring_index(sealed, ":", 1), F.substring_index(sealed, ":", -1)
        out = F.lit(None).cast("string")
        for key in self.keys.values():
            out = F.when(name == key.name, redaction.decrypt(body, F.lit(key.secret))).otherwise(out)
        return out

    def seal_anew(self, sealed: Column) -> Column:
        """The same text under the active key; what can't be read stays as it is."""
        fresh = self.encrypt(self.decrypt(sealed))
        return F.when(F.substring_index(sealed, ":", 1) == self.active().name, sealed).otherwise(F.coalesce(fresh, sealed))

    def metadata(self) -> list[dict]:
        """What may be shown of the keys: no secrets."""
        return [{"name": k.name, "created": k.created, "expires": k.expires, "active": k.name == self._active} for k in self.keys.values()]
