"""Named stages with dependencies, run one after another: times, errors that end only what depends on them, deadlines."""

from __future__ import annotations

import concurrent.futures
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    timeout_ms: float | None = None


@dataclass
class Outcome:
    outputs: dict = field(default_factory=dict)
    spans: dict[str, float] = field(default_factory=dict)
    error: dict | None = None


class Stages:
    """A checked order of stages: names are unique, dependencies known, none leads back to itself."""

    def __init__(self, stages: list[Stage]):
        by_name = {s.name: s for s in stages}
        if len(by_name) != len(stages):
            raise ValueError("stage names repeat")
        for s in stages:
            for n in s.needs:
                if n not in by_name:
                    raise ValueError(f"{s.name} needs an unknown stage {n!r}")
                if n == s.name:
                    raise ValueError(f"{s.name} needs itself")
        self.order: list[Stage] = []
        left = list(stages)
        while left:
            ready = [s for s in left if all(n in {d.name for d in self.order} for n in s.needs)]
            if not ready:
                raise ValueError("stages form a cycle: " + ", ".join(s.name for s in left))
            self.order.append(ready[0])
            left.remove(ready[0])

    def run(self, inputs: dict) -> Outcome:
        """Never raises for a failing stage: its error is named, what came before it is returned, what needs it is left out."""
        out, failed = Outcome(), set()
        for s in self.order:
            if failed & set(s.needs):
                failed.add(s.name)
                continue
            began = time.perf_counter()
            try:
                given = {**inputs, **out.outputs}
                if s.timeout_ms is None:
                    out.outputs[s.name] = s.run(given)
                else:
                    pool = concurrent.futures.ThreadPoolExecutor(1)
                    try:
                        out.outputs[s.name] = pool.submit(s.run, given).result(timeout=s.timeout_ms / 1000)
                    finally:
                        pool.shutdown(wait=False, cancel_futures=True)
            except Exception as e:  # noqa: BLE001 - an error is a result here
                failed.add(s.name)
                if out.error is None:
                    out.error = {"stage": s.name, "type": type(e).__name__, "message": str(e) or "timeout"}
            out.spans[s.name] = (time.perf_counter() - began) * 1000
        return out
