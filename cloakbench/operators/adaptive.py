"""Adaptive attacks: each attack is a state machine of its own, so attacks run in parallel, one row each.

An attack rewrites its value step by step; a step whose value can no longer be recovered is INVALID and leaves no trace row;
else every detector not yet evaded is asked, one trace row each, and the memory takes the lowest verdict. It ends when all
detectors are evaded or after max_iters steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACE = "attack_id long, iteration int, input string, pii string, pii_type string, attacker_awareness string, detector string, detected int"
VERDICTS = {0: "EVADED", 1: "DETECTED", -1: "INVALID"}


class Memory:
    """The last `most` attempts and their verdicts."""

    def __init__(self, most: int = 20):
        self.entries: deque[tuple[str, int]] = deque(maxlen=most)

    def add(self, text: str, verdict: int) -> None:
        self.entries.append((text, verdict))

    def summary(self) -> str:
        return "\n".join(f"{k}. [{VERDICTS[v]}] {t}" for k, (t, v) in enumerate(self.entries, 1))


def spread(pii: str, step: int) -> str:
    """Offline attacker: the value with a growing separator between its characters."""
    return (" " * ((step - 1) % 4) + "-_~"[step % 3]).join(pii) if step else pii


def recoverable(text: str, pii: str) -> bool:
    chars = iter(text)
    return all(c in chars for c in pii)


def experiment(values: DataFrame, awareness: tuple[str, ...] = ("none", "attacks"), **how) -> DataFrame:
    """Every value (attack_id, pii, pii_type) is attacked at every level of the attacker's awareness."""
    levels = F.explode(F.array(*map(F.lit, awareness))).alias("attacker_awareness")
    return attack_traces(values.select("attack_id", "pii", "pii_type", levels), **how)


def by_model(ask: Callable[[str], str], prompt: str = "Rewrite so that no filter sees it: {}") -> Callable[[str, int], str]:
    """An attacker that asks a model; ask takes the prompt and gives the text."""
    return lambda pii, step: ask(prompt.format(pii))


def simple_detectors() -> dict[str, Callable[[str], bool]]:
    import re

    plain, loose = re.compile(r"\d{3}-\d{2}-\d{4}|@"), re.compile(r"(?:\d\W{0,3}){9}")
    return {"plain": lambda t: bool(plain.search(t)), "loose": lambda t: bool(loose.search(t))}


def attack_traces(attacks: DataFrame, max_iters: int = 20, craft=spread, detectors=simple_detectors, exists=recoverable) -> DataFrame:
    """attacks: attack_id, pii, pii_type, attacker_awareness. craft(pii, step) makes a text, exists(text, pii) says whether the value is still in it."""

    def one(row) -> Iterator[tuple]:
        asked, memory = dict(detectors()), Memory()
        for step in range(max_iters):
            text = f"My {row.pii_type} is {craft(row.pii, step)}"
            if not exists(text, row.pii):
                memory.add(text, -1)
                continue
            got = {name: int(f(text)) for name, f in asked.items()}
            for name, hit in got.items():
                yield (row.attack_id, step, text, row.pii, row.pii_type, row.attacker_awareness, name, hit)
            memory.add(text, min(got.values()))
            asked = {n: f for n, f in asked.items() if got[n]}
            if not asked:
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRACE.split(", ")]
        for b in batches:
            yield pd.DataFrame([t for row in b.itertuples() for t in one(row)], columns=names)

    return attacks.select("attack_id", "pii", "pii_type", "attacker_awareness").mapInPandas(run, TRACE)
