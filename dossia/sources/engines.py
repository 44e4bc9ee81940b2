"""Extraction engines: a registry, a health probe that runs where the engines will, and an engine behind an HTTP service."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Ask = Callable[[bytes], str]

#: Answers of a service that are worth another try, and how often and how long to wait for it, doubled each time.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


@dataclass
class Engine:
    """What an engine is: its name, a session for each partition, and whether it can be used now (and why not)."""

    name: str
    open: Callable[[], Ask]
    available: Callable[[], tuple[bool, str]] = field(default=lambda: (True, ""))


_REGISTRY: dict[str, Callable[..., Engine]] = {}


def register(name: str, make: Callable[..., Engine]) -> None:
    _REGISTRY[name] = make


def get_engine(name: str, **options) -> Engine:
    if name not in _REGISTRY:
        raise ValueError(f"no engine {name}; there are: {', '.join(sorted(_REGISTRY)) or 'none'}")
    return _REGISTRY[name](**options)


def doctor(spark: SparkSession, engines: list[Engine], probes: int = 1) -> DataFrame:
    """engine, probe, ok, reason: each engine is asked on executors, ``probes`` times in tasks of their own, as its answer there is what counts."""
    by_name = {e.name: e.available for e in engines}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    ok, reason = by_name[r.engine]()
                except Exception as e:  # an engine that can't be asked isn't available
                    ok, reason = False, f"{type(e).__name__}: {e}"
                rows.append((r.engine, r.probe, ok, reason))
            yield pd.DataFrame(rows, columns=["engine", "probe", "ok", "reason"])

    asked = [(name, n) for name in by_name for n in range(probes)]
    frame = spark.createDataFrame(asked, "engine string, probe int").repartition(max(1, len(asked)))
    return frame.mapInPandas(ask, "engine string, probe int, ok boolean, reason string")


def resolve_model(wanted: str, known: list[str]) -> tuple[str | None, str]:
    """The served model that a name means: itself, or the only one whose letters and digits hold the name's. A service that lists none is trusted."""
    if not known or wanted in known:
        return wanted, ""
    plain = lambda s: re.sub(r"[^0-9a-z]", "", s.lower())
    like = [m for m in known if plain(wanted) and plain(wanted) in plain(m)]
    if len(like) == 1:
        return like[0], ""
    return None, f"no model {wanted}; there are: {', '.join(known[:8])}"


def http_engine(url: str, model: str, prompt: str = "", schema: dict | None = None, key: str = "", timeout: float = 120, tries: int = 4, wait: float = 0.5) -> Engine:
    """An engine behind a chat completion service.

    A refusal of the schema (400) is asked once more without it, and the session goes on without; busy or failing answers and broken connections are tried again after a
    while, twice as long each time or as long as the service says. The model's name is resolved against those served.
    """
    base = url.rstrip("/")

    def served() -> list[str]:
        import requests

        r = requests.get(f"{base}/models", timeout=min(4, timeout), headers={"Authorization": f"Bearer {key}"})
        r.raise_for_status()
        return [m.get("id", "") for m in r.json().get("data", [])]

    def available() -> tuple[bool, str]:
        try:
            known = served()
        except Exception:
            return False, f"no answer from {base}"
        found, reason = resolve_model(model, known)
        return found is not None, reason

    def open_session() -> Ask:
        import base64

        import requests

        session = requests.Session()
        session.headers["Authorization"] = f"Bearer {key}"
        try:
            named = resolve_model(model, served())[0] or model
        except Exception:  # the service may not list its models
            named = model
        state = {"schema": schema is not None}

        def post(body: dict) -> requests.Response:
            for n in range(tries):
                last, pause = n == tries - 1, wait * 2**n
                try:
                    r = session.post(f"{base}/chat/completions", json=body, timeout=timeout)
                except (requests.ConnectionError, requests.Timeout):
                    if last:
                        raise
                else:
                    if r.status_code not in AGAIN or last:
                        return r
                    said = r.headers.get("Retry-After", "")
                    pause = float(said) if said.isdigit() else pause
                time.sleep(pause)
            raise AssertionError("unreachable")

        def ask(content: bytes) -> str:
            image = "data:image/jpeg;base64," + base64.b64encode(content).decode()
            parts = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": image}}]
            body = {"model": named, "temperature": 0, "messages": [{"role": "user", "content": parts}]}
            formed = {"response_format": {"type": "json_schema", "json_schema": {"name": "document", "schema": schema}}}
            r = post(body | (formed if state["schema"] else {}))
            if r.status_code == 400 and state["schema"]:
                state["schema"] = False
                r = post(body)
            r.raise_for_status()
            return r.json()["choices"][0]["message"]["content"] or ""

        return ask

    return Engine(f"vlm:{model}", open_session, available)


register("vlm", http_engine)
