"""Hooks that talk to a chat model over HTTP. Nothing else in the library needs them; which one is made follows from the environment."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

#: Where a provider is found if its variables don't say otherwise.
PROVIDERS = {
    "openai": ("OPENAI_API_KEY", "OPENAI_BASE_URL", "https://api.openai.com/v1"),
    "local": ("", "OLLAMA_BASE_URL", "http://localhost:11434/v1"),
    "groq": ("GROQ_API_KEY", "GROQ_BASE_URL", "https://api.groq.com/openai/v1"),
}


def message_text(message: Any) -> str:
    """The text of what a model returns: a string, an object or mapping with content, or a list of parts with texts."""
    content = message.get("content", message) if isinstance(message, Mapping) else getattr(message, "content", message)
    if isinstance(content, (list, tuple)):
        return "".join(str(part.get("text", "")) if isinstance(part, Mapping) else str(part) for part in content)
    return content if isinstance(content, str) else str(content)


@dataclass(frozen=True)
class Chat:
    """A chat model at an address that takes the common chat-completions form. Called with (role, text) messages."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.0
    max_tokens: int = 2048
    timeout: float = 120.0

    def __call__(self, messages: list[tuple[str, str]]) -> str:
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": [{"role": r, "content": t} for r, t in messages]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return message_text(json.load(answer)["choices"][0]["message"])


def chat_model(names: Mapping[str, str], local: bool = False, env: Mapping[str, str] | None = None) -> Callable[[list[tuple[str, str]]], str]:
    """The model of the first provider that the environment has a key for; ``local`` prefers one on this machine to the last. ``names``: each provider's model."""
    env = os.environ if env is None else env
    kind = "openai" if env.get("OPENAI_API_KEY") else "local" if local else "groq"
    key, url, default = PROVIDERS[kind]
    return Chat(env.get(url) or default, names[kind], env.get(key, "") if key else "")


def planner_of(chat: Callable[[list[tuple[str, str]]], str]) -> Callable[[str, list[str], list[tuple[str, str]]], dict]:
    """A planning hook from a chat model: its answer's JSON object; an answer without one raises an error, and the rules plan instead."""
    ask = "Plan how to answer the user's last message. Return one JSON object: operation (chat, list_sources, read_source, search), scope (auto, none, selected, active, all), source_ids (from: {ids}), query, read_mode (overview, full_text), confidence (0 to 1), reason."

    def plan(question: str, candidates: list[str], history: list[tuple[str, str]]) -> dict:
        said = chat([("system", ask.format(ids=", ".join(candidates) or "none")), *history, ("user", question)])
        return json.loads(said[said.index("{") : said.rindex("}") + 1])

    return plan
