"""Security detections by pattern and by indicator, and attack categories; first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules (matched without regard to case), indicators with score and reason, and category keywords, in order.
RULES = [
    (r"SELECT.*FROM.*WHERE|UNION\s+SELECT|DROP\s+TABLE|INSERT\s+INTO.*VALUES", "SQL Injection"),
    (r"<script|javascript:|onerror\s*=|onclick\s*=|onload\s*=", "XSS Attack"),
    (r"\.\./\.\./|/etc/passwd|/etc/shadow|/proc/self", "Path Traversal"),
    (r"OR\s+1\s*=\s*1|OR\s+'1'\s*=\s*'1'|'\s*OR\s*''='", "Auth Bypass"),
    (r"eval\(|exec\(|system\(|passthru\(|shell_exec\(", "Code Injection"),
    (r"curl\s+.*\|\s*bash|wget\s+.*\|\s*sh", "Remote Code Execution"),
]
INDICATORS = [
    ("telemetry.analytics-cdn.net", 0.95, "Outbound connection to unknown external domain - not in baseline traffic"),
    ("AWS_ACCESS_KEY_ID", 0.92, "Environment variable enumeration - scanning for credentials"),
    ("AWS_SECRET_ACCESS_KEY", 0.92, "Environment variable enumeration - scanning for credentials"),
    ("lodash-utils", 0.88, "Unknown module initialization - not in dependency manifest"),
    ("169.254.169.254", 0.98, "SSRF to cloud metadata endpoint - internal IP accessed from application layer"),
    ("legacy_whitelist", 0.85, "Rate limiter bypass - security control circumvention"),
    ("/v1/oauth/token", 0.75, "Deprecated auth endpoint - unusual traffic pattern"),
    ("/proc/1/cgroup", 0.90, "Container escape recon - probing container boundaries"),
    ("serviceaccount/token", 0.93, "K8s service account access - credential harvesting"),
    ("impersonated admin@", 0.96, "Service account impersonation - privilege escalation"),
    ("attacker-domain.com", 0.99, "DNS exfiltration - base64 data in DNS queries"),
    ("/host/var/log", 0.87, "Host filesystem mount - container escape attempt"),
    ("mobile-app-2019", 0.70, "Legacy client ID - deprecated integration"),
]
CATEGORIES = [
    ("Supply Chain Attack", ["lodash-utils", "analytics-cdn", "environment scan"]),
    ("Credential Stuffing", ["/v1/oauth", "legacy_whitelist", "mobile-app-2019"]),
    ("Container Escape", ["/proc/1/cgroup", "serviceaccount/token", "/host/var"]),
    ("SSRF Attack", ["169.254.169.254", "metadata endpoint"]),
    ("Privilege Escalation", ["impersonated", "role binding"]),
    ("DNS Exfiltration", ["attacker-domain.com"]),
]


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for hit, value in reversed(cases):
        out = F.when(hit, value).otherwise(out)
    return out


def threat(line: Column) -> Column:
    """The name of the first security rule that a line breaks, or null."""
    return _first([(line.rlike(f"(?i){p}"), F.lit(n)) for p, n in RULES], F.lit(None).cast("string"))


def indicator(line: Column) -> Column:
    """A struct (is_novel, score, reason); a line that isn't a JSON object is a parse error."""
    low = F.lower(line)
    say = lambda hit, score, why: F.struct(F.lit(hit).alias("is_novel"), F.lit(score).alias("score"), F.lit(why).alias("reason"))
    found = _first([(low.contains(i.lower()), say(True, s, why)) for i, s, why in INDICATORS], say(False, 0.12, "Matches baseline patterns"))
    return F.when(F.try_parse_json(line).isNull(), say(False, 0.1, "Parse error")).otherwise(found)


def category(message: Column) -> Column:
    """The attack category of a message, or null."""
    low = F.lower(message)

    def any_word(words: list[str]) -> Column:
        out = low.contains(words[0])
        for w in words[1:]:
            out = out | low.contains(w)
        return out

    return _first([(any_word(words), F.lit(name)) for name, words in CATEGORIES], F.lit(None).cast("string"))


def demo_class(category_col: Column) -> Column:
    """The three classes of the demo's lines."""
    return F.when(category_col.isin("attack", "novel-attack"), category_col).otherwise("normal")
