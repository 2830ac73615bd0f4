"""Model calls as columns: providers of replies and vectors, a chain that goes on to the next when one fails, and labels for queries that no rule reads."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("lexical", "navigational", "episodic", "semantic")
MOST = 512


class Provider(Protocol):
    name: str

    def chat(self, system: str, user: str) -> dict: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Offline:
    """Deterministic and without a network: replies from the commonest words, vectors by signed hashing. It shows that a plan runs, not how good it is."""

    name = "offline"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def chat(self, system: str, user: str) -> dict:
        words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9+_.-]+|[0-9]+", user)]
        top = [w for w, _ in Counter(words).most_common(5)]
        return {"summary": " ".join(user.split())[:200], "topics": top, "labels": ["semantic"], "intent_queries": [f"what is {w}" for w in top[:3]]}

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w, n in Counter(re.findall(r"\w+", t.lower())).items():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                v[h % self.dim] += (1 if h >> 32 & 1 else -1) * (1 + math.log(n))
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


class Chain:
    """Providers in order: one that fails is left for the next, and isn't gone back to."""

    def __init__(self, providers: list[Provider]):
        self.providers, self.at = providers, 0

    @property
    def name(self) -> str:
        return self.providers[self.at].name

    def _call(self, what: str, *args):
        while True:
            try:
                return getattr(self.providers[self.at], what)(*args)
            except Exception:
                if self.at + 1 == len(self.providers):
                    raise
                self.at += 1

    def chat(self, system: str, user: str) -> dict:
        return self._call("chat", system, user)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._call("embed", texts)


def embedded(rows: DataFrame, provider: Provider, block: int = 64) -> DataFrame:
    """(id, embedding) of (id, text), in blocks of calls."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), block):
                q = p.iloc[i : i + block]
                yield pd.DataFrame({"id": q["id"], "embedding": provider.embed(q["text"].fillna("").tolist())})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<double>")


def labelled(queries: DataFrame, provider: Provider) -> DataFrame:
    """``labels`` of queries (query_id, text, rules): those of the model, once for each text that no rule reads (``rules`` empty); of a call that fails, semantic. The
    last ``MOST`` replies of a task are kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for p in parts:
            for t in p["text"]:
                if t not in known:
                    try:
                        said = [x for x in provider.chat("Label a search.", t).get("labels", []) if x in LABELS]
                    except Exception:  # noqa: BLE001  a model that fails leaves the rules' answer
                        said = []
                    known[t] = ",".join(said) or "semantic"
                    if len(known) > MOST:
                        known.pop(next(iter(known)))
            yield pd.DataFrame({"text": p["text"], "labels": [known.get(t, "semantic") for t in p["text"]]})

    asked = queries.where("rules = ''").select("text").distinct()
    return queries.join(asked.mapInPandas(run, "text string, labels string"), "text", "left").withColumn("labels", F.coalesce("labels", F.lit("")))
