"""A model server over HTTP: chat completions, token counts, snapshots of its settings.

Everything is made of functions that ``readers.answered`` and
``udfs.token_count`` call on the executors; only the standard library is used.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from quillspan.sources.sinks import published

CHAT_SECONDS, TOKENIZE_SECONDS, PROBE_SECONDS = 3600, 60, 30


def call(url: str, body: dict | None = None, seconds: float = PROBE_SECONDS) -> dict:
    """The JSON that a server answers, to a POST if there is a body; an error for a status of 400 or more."""
    data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=seconds) as r:
        return json.loads(r.read())


def chat_body(prompt: str, generation: dict, seed: int | None = None, thinking: bool = True, system: str | None = None) -> dict:
    """The request for one prompt. ``generation``: sampling settings as the server names them."""
    messages = [{"role": "system", "content": system}] if system else []
    body = {"messages": [*messages, {"role": "user", "content": prompt}], **generation}
    if seed is not None:
        body["seed"] = seed
    if not thinking:
        body["chat_template_kwargs"] = {"enable_thinking": False}
    return body


def record(item: dict, answer: dict, seconds: float, more: dict | None = None) -> dict:
    """An answer record from an item (id, lang, gold) and what the server said; fields that it left out are null."""
    choice = answer["choices"][0]
    said = choice.get("message") or {}
    out = {k: item.get(k) for k in ("id", "lang", "gold")}
    out |= {k: said.get(k) for k in ("content", "reasoning_content")}
    return out | {"finish_reason": choice.get("finish_reason"), "usage": answer.get("usage"), "timings": answer.get("timings"), "wall": seconds} | (more or {})


def chat(base: str, generation: dict, prompt: str = "prompt", seed: int | None = None, thinking: bool = True, tag: str | None = None, seconds: float = CHAT_SECONDS) -> Callable[[], Callable[[dict], dict | None]]:
    """A responder for ``readers.answered``: asks for the item's ``prompt``; a failed request gives None, so the item stays pending."""

    def make() -> Callable[[dict], dict | None]:
        def ask(item: dict) -> dict | None:
            began = time.monotonic()
            try:
                answer = call(f"{base}/v1/chat/completions", chat_body(item[prompt], generation, seed, thinking), seconds)
                return record(item, answer, time.monotonic() - began, {"tag": tag, "seed": seed, "thinking": None if thinking else "off"})
            except (OSError, urllib.error.URLError, ValueError, KeyError, IndexError):
                return None

        return ask

    return make


def tokenize(base: str, seconds: float = TOKENIZE_SECONDS) -> Callable[[], Callable[[str], int]]:
    """A token counter for ``udfs.token_count`` that asks the server."""
    return lambda: lambda text: len(call(f"{base}/tokenize", {"content": text}, seconds)["tokens"])


def healthy(base: str, seconds: float = PROBE_SECONDS) -> bool:
    try:
        call(f"{base}/health", seconds=seconds)
        return True
    except (OSError, urllib.error.URLError, ValueError):
        return False


def snapshot(base: str, path: str | Path) -> bool:
    """Write the server's settings to ``path`` unless that is there already; whether it was written."""
    path = Path(path)
    if path.exists():
        return False
    published(path, json.dumps(call(f"{base}/props"), indent=2, ensure_ascii=False))
    return True
