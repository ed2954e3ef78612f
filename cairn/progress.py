"""Weighted progress of a plan's steps, reported to listeners."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

Listener = Callable[[int, str], None]


@dataclass
class Step:
    weight: int
    total: int = 1
    done: int = 0

    @property
    def percent(self) -> int:
        return min(100, max(0, int(self.done * 100 / self.total + 0.5))) if self.total > 0 else 0


@dataclass
class Progress:
    """Steps by name in order; listeners hear a step's name and the total percentage whenever that has changed."""

    weights: dict[str, int]
    listeners: list[Listener] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.steps = {name: Step(w) for name, w in self.weights.items()}
        self._said = -1

    def _step(self, name: str) -> Step:
        if name not in self.steps:
            raise KeyError(f"{name} is no step of this plan")
        return self.steps[name]

    def register(self, listener: Listener) -> None:
        self.listeners.append(listener)

    def estimate(self, name: str, total: int) -> None:
        self._step(name).total = total

    def record(self, name: str, done: int = 1) -> None:
        step = self._step(name)
        step.done += done
        self._report(name)

    def complete(self, name: str) -> None:
        step = self._step(name)
        step.total = max(1, step.total)
        step.done = step.total
        self._report(name)

    skip = complete

    def complete_all(self) -> None:
        for name in self.steps:
            self.complete(name)

    @property
    def percent(self) -> int:
        whole = sum(s.weight for s in self.steps.values())
        return int(sum(s.percent * s.weight for s in self.steps.values()) / whole + 0.5) if whole else 0

    def _report(self, name: str) -> None:
        if self.percent != self._said:
            self._said = self.percent
            for listener in self.listeners:
                listener(self._said, name)


def elapsed_text(milliseconds: int) -> str:
    """hh:mm:ss.mmm"""
    seconds, ms = divmod(milliseconds, 1000)
    minutes, s = divmod(seconds, 60)
    hours, m = divmod(minutes, 60)
    return f"{hours:02d}:{m:02d}:{s:02d}.{ms:03d}"


def rate_text(bytes_done: int, milliseconds: int) -> str:
    """MiB and MiB per second."""
    mib = bytes_done / (1 << 20)
    return f"{mib:.3f} MiB ({mib / (milliseconds / 1000):.3f} MiB/s)" if milliseconds else f"{mib:.3f} MiB"
