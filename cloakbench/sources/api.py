"""A remote model over HTTP: provider by the keys that are set, retries, structured answers. Offline work needs none of it."""

from __future__ import annotations

import functools
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable


class AuthenticationError(Exception):
    """The provider refuses the key: trying again does not help."""


def provider(model: str) -> tuple[str, str | None, str]:
    """(address, key, model name): the key of the router wins, and there a model without a maker is given one."""
    router = os.environ.get("OPENROUTER_API_KEY")
    if router:
        return "https://openrouter.ai/api/v1/chat/completions", router, model if "/" in model else f"openai/{model}"
    return "https://api.openai.com/v1/chat/completions", os.environ.get("OPENAI_API_KEY"), model


def retry(times: int = 5, delay: float = 1.0, grow: str | None = None, by: float = 0.1, most: float = 2.0, fixed_models: tuple[str, ...] = ()) -> Callable:
    """Call again after a failure, up to `times` in all. grow names a number of the keyword `data` that rises each time, but for fixed_models."""

    def around(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            for left in range(times - 1, -1, -1):
                try:
                    return f(*args, **kwargs)
                except AuthenticationError:
                    raise
                except Exception:
                    if not left:
                        raise
                data = kwargs.get("data") or {}
                if grow in data and data.get("model") not in fixed_models:
                    data[grow] = min(most, data[grow] + by)
                time.sleep(delay)

        return call

    return around


@retry(grow="temperature", fixed_models=("gpt-5-mini",))
def post(data: dict, structured: bool = True, send: Callable = urllib.request.urlopen) -> dict | str:
    """The answer to a chat request: text, or with structured=True the parsed JSON and the log-probabilities of its tokens."""
    url, key, model = provider(data.get("model", ""))
    if not key:
        raise AuthenticationError("set OPENROUTER_API_KEY or OPENAI_API_KEY, or use an offline model")
    body = json.dumps(data | {"model": model}).encode()
    request = urllib.request.Request(url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with send(request) as got:
            choice = json.loads(got.read())["choices"][0]
    except urllib.error.HTTPError as e:
        raise (AuthenticationError if e.code in (401, 403) else ValueError)(f"the model's provider answered {e.code}") from e
    text = choice["message"]["content"]
    if not structured:
        return text
    return json.loads(text) | {"tokens": (choice.get("logprobs") or {}).get("content") or []}


def model_over_http(model: str, prompt: str, structured: bool = True, **more) -> Callable:
    """A load() for operators.backends: each text of a batch goes out as one request."""

    def load():
        def answer(text: str) -> str:
            messages = [{"role": "system", "content": prompt}, {"role": "user", "content": text}]
            got = post(data={"model": model, "messages": messages, "temperature": 0} | more, structured=structured)
            return json.dumps(got, ensure_ascii=False) if structured else got

        return lambda texts: [answer(t) for t in texts]

    return load
