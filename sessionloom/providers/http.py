"""A provider over HTTP in the common chat-completions form, with the standard library."""

from __future__ import annotations

import functools
import http.client
import json
import re
import ssl
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .base import ContextOverflow, Reply


def bypass_patterns(text: str) -> list[re.Pattern]:
    """Comma-separated patterns for hosts that need no proxy; an invalid one is a ValueError."""
    try:
        return [re.compile(x.strip()) for x in text.split(",") if x.strip()]
    except re.error as e:
        raise ValueError(f"invalid proxy bypass pattern: {e}") from e


def _patient(kind: type, wait: float):
    """A connection class that waits ``wait`` seconds to be connected, and then as long as the request says."""
    class Connection(kind):
        def connect(self) -> None:
            reading, self.timeout = self.timeout, wait
            try:
                super().connect()
            finally:
                self.timeout = reading
            self.sock.settimeout(reading)

    return Connection


class _Plain(urllib.request.HTTPHandler):
    def __init__(self, wait: float):
        super().__init__()
        self._wait = wait

    def http_open(self, request):
        return self.do_open(_patient(http.client.HTTPConnection, self._wait), request)


class _Secure(urllib.request.HTTPSHandler):
    def __init__(self, wait: float, context: ssl.SSLContext):
        super().__init__(context=context)
        self._wait, self._used = wait, context

    def https_open(self, request):
        return self.do_open(functools.partial(_patient(http.client.HTTPSConnection, self._wait), context=self._used), request)


@dataclass
class HttpProvider:
    model_name: str
    api_key: str
    base_url: str
    proxy: str = ""
    proxy_bypass: str = ""
    verify_ssl: bool = False
    timeout: float = 120.0
    user_agent: str = "curl/8.0"
    headers: dict[str, str] = field(default_factory=dict)
    connect_timeout: float = 10.0

    def __post_init__(self) -> None:
        if not self.api_key:
            raise ValueError("an API key is needed")
        self._free = bypass_patterns(self.proxy_bypass)

    def _opener(self) -> urllib.request.OpenerDirector:
        context = ssl.create_default_context()
        if not self.verify_ssl:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        host = re.sub(r"^[a-z]+://|[:/].*$", "", self.base_url)
        through = self.proxy and not any(p.search(host) for p in self._free)
        return urllib.request.build_opener(urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy} if through else {}), _Plain(self.connect_timeout), _Secure(self.connect_timeout, context))

    # The fields of the wire format, and the words by which servers tell of an overflow.
    def complete(self, system: str, prompt: str, temperature: float = 0.3, max_tokens: int = 4096) -> Reply:
        body = {"model": self.model_name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}", "User-Agent": self.user_agent} | self.headers
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        try:
            with self._opener().open(request, timeout=self.timeout) as answer:
                return parse_reply(json.load(answer))
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")
            if e.code == 400 and ("context_length" in text or "max_tokens" in text):
                raise ContextOverflow(text[:300]) from e
            raise RuntimeError(f"HTTP {e.code}: {text[:300]}") from e

    def close(self) -> None:
        pass


def parse_reply(data: dict) -> Reply:
    """The first choice's content, or its reasoning where that is empty."""
    if not data.get("choices"):
        raise ValueError("the reply has no choices")
    message, usage = data["choices"][0].get("message") or {}, data.get("usage") or {}
    return Reply(message.get("content") or message.get("reasoning_content") or "", usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0))
