"""Senders of notifications: Slack, web hooks, e-mail and GitHub issues, made by name.

A sender is a small object that travels to the executors; called with an event
(a dict whose ``payload`` is the JSON that ``routing.payload`` made), it delivers it or
raises, so it fits ``sinks.notify``. Further kinds are registered by name.
"""

from __future__ import annotations

import json
import os
import smtplib
import ssl
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from email.message import EmailMessage
from urllib.parse import quote, urlparse


def _posted(url: str, body: str, headers: dict[str, str], timeout: float, method: str = "POST") -> str:
    request = urllib.request.Request(url, body.encode() if body else None, {"Content-Type": "application/json", **headers}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def _url_problems(url: str) -> list[str]:
    parts = urlparse(url)
    return [] if parts.scheme in ("http", "https") and parts.netloc else ["a http(s) address is needed"]


@dataclass
class Webhook:
    """Posts the payload to an address; ``token`` goes along as a bearer token."""

    url: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    token: str | None = None
    timeout: float = 30.0
    enabled: bool = True

    def problems(self) -> list[str]:
        return _url_problems(self.url) + ["the timeout must be positive"] * (self.timeout <= 0)

    def __call__(self, event: dict) -> None:
        extra = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        extra |= {"Idempotency-Key": event["key"]} if event.get("key") else {}
        _posted(self.url, event["payload"], {**self.headers, **extra}, self.timeout)


@dataclass
class Slack(Webhook):
    """Posts to an incoming web hook, which answers 'ok'."""

    def __call__(self, event: dict) -> None:
        said = _posted(self.url, event["payload"], self.headers, self.timeout)
        if said.strip() != "ok":
            raise RuntimeError(f"the hook answered {said[:100]!r}")


@dataclass
class Email:
    """Sends subject and body of the payload by SMTP."""

    host: str = "localhost"
    port: int = 587
    sender: str = ""
    recipients: list[str] = field(default_factory=list)
    user: str | None = None
    password: str | None = None
    tls: bool = True
    timeout: float = 30.0
    enabled: bool = True

    def problems(self) -> list[str]:
        return ["a sender is needed"] * (not self.sender) + ["recipients are needed"] * (not self.recipients) + ["the timeout must be positive"] * (self.timeout <= 0)

    def message(self, event: dict) -> EmailMessage:
        said = json.loads(event["payload"])
        out = EmailMessage()
        out["Subject"], out["From"], out["To"] = said["subject"].replace("\n", " "), self.sender, ", ".join(self.recipients)
        out.set_content(said.get("body") or "")
        return out

    def __call__(self, event: dict) -> None:
        with smtplib.SMTP(self.host, self.port, timeout=self.timeout) as server:
            if self.tls:
                server.starttls(context=ssl.create_default_context())
            if self.user:
                server.login(self.user, self.password or "")
            server.send_message(self.message(event))


@dataclass
class GitHubIssue:
    """Opens an issue unless an open one has its title."""

    repository: str = ""
    token: str = ""
    api: str = "https://api.github.com"
    timeout: float = 30.0
    enabled: bool = True

    def problems(self) -> list[str]:
        named = self.repository.count("/") == 1 and all(self.repository.split("/"))
        return ["a repository owner/name is needed"] * (not named) + ["a token is needed"] * (not self.token) + _url_problems(self.api)

    def __call__(self, event: dict) -> None:
        headers = {"Authorization": f"Bearer {self.token}", "Accept": "application/vnd.github+json"}
        title = json.loads(event["payload"])["title"]
        wanted = quote(f'repo:{self.repository} is:issue is:open in:title "{title}"')
        found = json.loads(_posted(f"{self.api}/search/issues?q={wanted}", "", headers, self.timeout, "GET"))
        if not any(i["title"] == title for i in found.get("items", [])):
            _posted(f"{self.api}/repos/{self.repository}/issues", event["payload"], headers, self.timeout)


@dataclass
class Lines:
    """Appends each notice's key and payload, as a line of JSON, to a file of its own in a folder."""

    folder: str = ""
    enabled: bool = True

    def problems(self) -> list[str]:
        return ["a folder is needed"] * (not self.folder)

    def __call__(self, event: dict) -> None:
        if not hasattr(self, "_file"):
            os.makedirs(self.folder, exist_ok=True)
            self._file = f"{self.folder}/{uuid.uuid4().hex}.jsonl"
        with open(self._file, "a", encoding="utf-8") as f:
            f.write(json.dumps({"key": event.get("key"), "payload": event["payload"]}) + "\n")


_kinds: dict[str, Callable] = {"lines": Lines, "slack": Slack, "webhook": Webhook, "email": Email, "github": GitHubIssue}


def register(kind: str, maker: Callable) -> None:
    """Makes a kind of sender known; a known one is replaced."""
    _kinds[kind] = maker


def create(kind: str, **settings):
    """A sender by the name of its kind, its settings checked."""
    if kind not in _kinds:
        raise ValueError(f"unknown kind of notifier {kind}")
    out = _kinds[kind](**settings)
    problems = out.problems() if hasattr(out, "problems") else []
    if problems:
        raise ValueError(f"{kind}: " + "; ".join(problems))
    return out


def kinds() -> list[str]:
    return list(_kinds)
