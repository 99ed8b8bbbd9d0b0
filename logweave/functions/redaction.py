"""Redaction of personal data and credentials by ordered regex rules, and storage policies.

Rules run in a fixed order, each on what the previous ones left. Replacements
that depend on the match (hashes, kept formats) are made for each match by
splitting at the pattern and zipping the pieces back together, inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families with their patterns (matched without regard to case) and descriptions, in the order of evaluation.
PATTERNS = {
    "email": [(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email address")],
    "phone": [
        (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "US phone"),
        (r"\b\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", "international phone"),
        (r"\b\(\d{3}\)\s?\d{3}[-.\s]?\d{4}\b", "formatted phone"),
    ],
    "ssn": [(r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "SSN")],
    "credit_card": [
        (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "credit card"),
        (r"\b\d{4}[-\s]?\d{6}[-\s]?\d{5}\b", "AMEX card"),
    ],
    "ip_address": [
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IPv4"),
        (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "IPv6 full"),
        (r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b", "IPv6 compressed"),
    ],
    "api_key": [
        (r"\b[A-Za-z0-9]{32,}\b", "API key"),
        (r"\bsk[-_][A-Za-z0-9]{24,}\b", "secret key"),
        (r"\bapi[-_]?key[=:]\s*['\"]?[A-Za-z0-9_-]+['\"]?", "API key assignment"),
        (r"\btoken[=:]\s*['\"]?[A-Za-z0-9_.-]+['\"]?", "token assignment"),
        (r"\bbearer\s+[A-Za-z0-9_.-]+", "bearer token"),
    ],
    "password": [
        (r"\bpassword[=:]\s*['\"]?[^\s'\"]+['\"]?", "password field"),
        (r"\bpwd[=:]\s*['\"]?[^\s'\"]+['\"]?", "pwd field"),
        (r"\bsecret[=:]\s*['\"]?[^\s'\"]+['\"]?", "secret field"),
    ],
    "username": [
        (r"\buser(?:name)?[=:]\s*['\"]?[A-Za-z0-9_.-]+['\"]?", "username field"),
        (r"\blogin[=:]\s*['\"]?[A-Za-z0-9_.-]+['\"]?", "login field"),
    ],
    "date_of_birth": [
        (r"\b(?:dob|birth[-_]?date)[=:]\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", "DOB field"),
        (r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\b", "date format"),
    ],
}
# Which families a level redacts; names and addresses have no patterns.
LEVELS = {
    "none": [],
    "minimal": ["ssn", "credit_card", "password"],
    "standard": ["email", "phone", "ssn", "credit_card", "ip_address", "api_key", "password"],
    "strict": ["email", "phone", "ssn", "credit_card", "ip_address", "api_key", "password", "username", "name"],
    "paranoid": [*PATTERNS, "name", "address", "custom"],
}


@dataclass(frozen=True)
class CustomPattern:
    name: str
    pattern: str
    kind: str = "custom"


@dataclass
class Redactor:
    """A level or explicit families, custom patterns, and how to replace: by tag, with hash, or keeping the format."""

    level: str = "standard"
    kinds: list[str] | None = None
    custom: list[CustomPattern] = field(default_factory=list)
    tag: str = "[REDACTED:{type}]"
    hashed: bool = False
    keep_format: bool = False

    def rules(self) -> list[tuple[str, str, str]]:
        """(kind, pattern, description) in order; custom patterns follow those of their kind."""
        if self.level == "none" and self.kinds is None:
            return []
        wanted = set(LEVELS[self.level] if self.kinds is None else self.kinds)
        by: dict[str, list] = {k: list(p) for k, p in PATTERNS.items() if k in wanted}
        for c in self.custom:
            by.setdefault(c.kind, []).append((c.pattern, c.name))
        return [(kind, f"(?i){p}", said) for kind, patterns in by.items() for p, said in patterns]

    def _replacement(self, kind: str, match: Column) -> Column:
        tag = self.tag.replace("{type}", kind)
        if self.hashed:
            return F.concat(F.lit(f"{tag}:"), F.substring(F.sha2(match, 256), 1, 8))
        stars = F.repeat(F.lit("*"), F.length(match))
        if kind == "email":
            sides = F.split(match, "@")
            return F.when(F.size(sides) == 2, F.concat(F.repeat(F.lit("*"), F.length(sides[0])), F.lit("@"), F.repeat(F.lit("*"), F.length(sides[1])))).otherwise(stars)
        if kind == "phone":
            return F.regexp_replace(match, r"\d", "*")
        if kind == "credit_card":
            return F.regexp_replace(match, r"\d(?=\d{4})", "*")
        if kind == "ip_address":
            return F.lit("xxx.xxx.xxx.xxx")
        return stars

    def _apply(self, text: Column, kind: str, pattern: str) -> Column:
        if not (self.hashed or self.keep_format):
            return F.regexp_replace(text, pattern, self.tag.replace("{type}", kind).replace("\\", "\\\\").replace("$", "\\$"))

        def glue(t: Column) -> Column:
            found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: self._replacement(kind, m))
            glued = F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            return F.when(t.rlike(pattern), F.array_join(glued, "")).otherwise(t)

        # The text is bound once: each rule adds to the expression instead of multiplying it.
        return F.transform(F.array(text), glue)[0]

    def redact(self, text: Column) -> Column:
        """The redacted text; null stays null."""
        for kind, pattern, _ in self.rules():
            text = self._apply(text, kind, pattern)
        return text

    def counts(self, df, text_col: str, prefix: str = "n_"):
        """``df`` with the redacted text as ``redacted`` and a count for each kind.

        Each rule counts in what the previous ones left. Steps are projections of
        their own, so that no text is rewritten twice.
        """
        out = df.withColumn("redacted", F.col(text_col))
        kinds = list(dict.fromkeys(k for k, _, _ in self.rules()))
        out = out.withColumns({prefix + k: F.lit(0) for k in kinds})
        for kind, pattern, _ in self.rules():
            out = out.withColumn(prefix + kind, F.col(prefix + kind) + F.coalesce(F.regexp_count("redacted", F.lit(pattern)), F.lit(0)))
            out = out.withColumn("redacted", self._apply(F.col("redacted"), kind, pattern))
        return out


def composite(redactors: list[Redactor], text: Column) -> Column:
    for r in redactors:
        text = r.redact(text)
    return text


@dataclass
class Privacy:
    """What may be kept of a raw line. The level 'maximum' overrides the rest."""

    level: str = "enhanced"
    mode: str = "store_redacted"
    raw_policy: str = "redact_then_store"
    redactor: Redactor = field(default_factory=Redactor)

    def __post_init__(self):
        if self.level == "maximum":
            self.mode, self.raw_policy, self.redactor = "never_store", "discard", Redactor("paranoid")

    def sanitize(self, text: Column) -> Column:
        """A struct (original_hash, sanitized_text)."""
        digest = F.sha2(text, 256)
        kept = {
            "discard": F.lit(""),
            "hash_only": F.concat(F.lit("[HASH:"), F.substring(digest, 1, 16), F.lit("]")),
        }.get(self.raw_policy, self.redactor.redact(text))
        return F.struct(digest.alias("original_hash"), kept.alias("sanitized_text"))

    def can_store(self) -> bool:
        return self.mode not in ("never_store", "store_embeddings_only")


def encrypt(text: Column, key: Column) -> Column:
    """AES-GCM by the built-in function, in base64; the key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def decrypt(data: Column, key: Column) -> Column:
    """The text, or null where the key doesn't fit."""
    return F.try_aes_decrypt(F.unbase64(data), key, F.lit("GCM")).cast("string")


def derive_key(password: str, salt: bytes, rounds: int = 480_000) -> bytes:
    """A 32-byte key from a password by PBKDF2 with SHA-256, on the driver."""
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)
