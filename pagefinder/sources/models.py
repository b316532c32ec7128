"""The models that a language-model service offers."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen


def _get(url: str, headers: dict[str, str]) -> bytes:
    with urlopen(Request(url, headers=headers), timeout=30) as answer:
        return answer.read()


def list_models(base_url: str, api_key: str, get: Callable[[str, dict[str, str]], bytes] = _get) -> list[str]:
    """Ids of the models behind ``base_url``, sorted; any failure is a RuntimeError that says why."""
    try:
        listed = json.loads(get(f"{base_url.rstrip('/')}/models", {"Authorization": f"Bearer {api_key}"}))
        return sorted(m["id"] for m in listed["data"])
    except Exception as e:
        raise RuntimeError(f"no list of models: {e}") from e
