"""Step functions over the ordered windows of one stream; shared by batch folds and streaming state."""

from __future__ import annotations

import math
from dataclasses import dataclass

LISTENING, SUSPECT, ALERT = "LISTENING", "SUSPECT", "ALERT"


@dataclass
class Ema:
    """Exponential moving average that starts at its first value."""

    alpha: float = 0.3
    value: float | None = None

    def step(self, x: float) -> float:
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value


@dataclass
class AlertPolicy:
    """Hysteresis: ``n`` hot windows in a row raise an alert, which holds until one falls below ``leave``.

    After an alert no new one is raised for ``cooldown`` seconds; the state is then SUSPECT while hot.
    """

    n: int = 5
    enter: float = 99.0
    leave: float = 95.0
    cooldown: float = 30.0
    state: str = LISTENING
    streak: int = 0
    cooldown_until: float = 0.0
    last_t: float | None = None

    def __post_init__(self):
        if self.n < 1 or not 0 <= self.leave < self.enter <= 100:
            raise ValueError("needs n >= 1 and 0 <= leave < enter <= 100")

    def step(self, percentile: float, t: float) -> str:
        if not 0 <= percentile <= 100 or math.isnan(percentile):
            raise ValueError(f"percentile {percentile} is outside 0..100")
        if self.last_t is not None and t < self.last_t:
            raise ValueError(f"time went back from {self.last_t} to {t}")
        self.last_t = t
        hot = percentile >= self.enter
        if self.state == ALERT:
            if percentile < self.leave:
                self.state, self.streak, self.cooldown_until = LISTENING, 0, t + self.cooldown
            return self.state
        if not hot:
            self.state, self.streak = LISTENING, 0
            return self.state
        self.streak += 1
        raised = self.state == SUSPECT and self.streak >= self.n and t >= self.cooldown_until
        self.state = ALERT if raised else SUSPECT
        return self.state


@dataclass
class Throttle:
    """At most one card per interval; the latest waiting card is shown at the next chance, repeats are dropped."""

    interval: float = 2.0
    shown: tuple | None = None
    shown_at: float | None = None

    def step(self, card: tuple, t: float) -> bool:
        """Whether this card is shown now; a card that is not shown is replaced by the next one offered."""
        if card == self.shown or self.shown_at is not None and t - self.shown_at < self.interval:
            return False
        self.shown, self.shown_at = card, t
        return True


@dataclass
class TimedThrottle:
    """At most one card per interval, with a timer: the latest waiting card is shown when the interval ends.

    A card equal to the one on show is dropped and takes a waiting one with it.
    """

    interval: float = 2.0
    shown: str | None = None
    shown_at: float | None = None
    waiting: str | None = None

    def offer(self, card: str, t: float) -> bool:
        """Whether the card is shown now; if not, it waits (in place of an earlier one) or is dropped."""
        if card == self.shown:
            self.waiting = None
            return False
        if self.shown_at is not None and t - self.shown_at < self.interval:
            self.waiting = card
            return False
        self.shown, self.shown_at, self.waiting = card, t, None
        return True

    def due(self) -> float | None:
        """When the waiting card is to be shown."""
        return None if self.waiting is None else self.shown_at + self.interval

    def flush(self) -> str:
        """Show the waiting card at its time."""
        self.shown, self.shown_at, self.waiting = self.waiting, self.due(), None
        return self.shown


@dataclass
class Capture:
    """Byte and time bounds of a raw capture; refused chunks do not count."""

    max_bytes: int = 16 << 20
    max_seconds: float = 300.0
    bytes_per_second: int = 32_000
    n_bytes: int = 0
    n_chunks: int = 0

    def step(self, size: int) -> bool:
        total = self.n_bytes + size
        if size % 2 or total > self.max_bytes or total / self.bytes_per_second > self.max_seconds:
            return False
        self.n_bytes, self.n_chunks = total, self.n_chunks + 1
        return True
