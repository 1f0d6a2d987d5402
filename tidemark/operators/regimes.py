"""Background models by lighting regime, with grids that are learned.

A camera's frames fall into a few regimes of lighting, told apart by a descriptor of the whole frame. Each regime has learned
what its cells normally are: their colours, how far colours stray from brightness alone, how much darker than their
surroundings they get, and how much texture they show. A frame is scored by what its regime knew before it; timer frames teach
it then. A camera that has moved, by phase correlation, and is found moved again, starts anew."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.operators import blobs
from tidemark.operators.fitting import phase_shift


@dataclass(frozen=True)
class RegimeConfig:
    """The published rates, floors and limits; radii are of box means, (2 r + 1) cells wide."""

    rate: float = 0.15
    slow: float = 0.10
    warmup: int = 25
    most: int = 5
    near: float = 0.18
    noise: float = 3.0
    colour_z: float = 6.0
    dark_z: float = 6.0
    colour_floor: float = 0.5
    dark_floor: float = 0.03
    dark_variance: float = 9e-4
    hidden: float = 0.35
    texture: float = 2.0
    texture_radius: int = 2
    around_radius: int = 25
    smooth_radius: int = 1
    least_area: int = 12
    novelty: float = 0.60
    big: float = 0.04
    night: float = 60.0
    bump: float = 6.0
    confidence: float = 20.0


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """The mean of the square around each cell, mirrored at the edges, from sums over prefixes."""
    if not radius:
        return a
    side = 2 * radius + 1
    sums = np.pad(np.pad(a, radius, "symmetric").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]) / side**2


def luma(planes: np.ndarray) -> np.ndarray:
    return 0.299 * planes[0] + 0.587 * planes[1] + 0.114 * planes[2]


def described(y: np.ndarray) -> np.ndarray:
    """As grid.descriptor: brightness, contrast, and the upper quarter by the lower one."""
    low, high = np.percentile(y, [25, 75])
    return np.array([y.mean() / 255, y.std() / 64, y[y >= high].mean() / max(y[y <= low].mean(), 1.0) / 8])


@dataclass
class Regime:
    """levels and spreads: means and variances of five layers (three colours, colour distortion, relative darkness);
    detail: the texture that is expected; and the regime's descriptor and count of lessons."""

    levels: np.ndarray
    spreads: np.ndarray
    detail: np.ndarray
    descriptor: np.ndarray
    count: int

    @staticmethod
    def founded(planes: np.ndarray, descriptor: np.ndarray, c: RegimeConfig) -> Regime:
        none = np.zeros_like(planes[:2])
        starts = np.array([c.noise**2] * 3 + [1.0, c.dark_variance])[:, None, None]
        return Regime(np.concatenate((planes, none)), np.broadcast_to(starts, (5, *planes.shape[1:])).copy(), textured(planes, c), descriptor, 1)

    def taught(self, planes: np.ndarray, descriptor: np.ndarray, residuals: np.ndarray, c: RegimeConfig) -> Regime:
        rates = np.array([c.rate] * 3 + [c.slow] * 2)[:, None, None]
        off = np.concatenate((planes, residuals)) - self.levels
        return Regime(
            self.levels + rates * off, (1 - rates) * (self.spreads + rates * off * off), self.detail + c.rate * (textured(planes, c) - self.detail),
            self.descriptor + c.rate * (descriptor - self.descriptor), self.count + 1,
        )

    def merged(self, other: Regime) -> Regime:
        share = self.count / (self.count + other.count)
        mix = lambda a, b: share * a + (1 - share) * b
        return Regime(*(mix(getattr(self, f), getattr(other, f)) for f in ("levels", "spreads", "detail", "descriptor")), self.count + other.count)


def textured(planes: np.ndarray, c: RegimeConfig) -> np.ndarray:
    y = luma(planes)
    return box_mean(np.abs(y - box_mean(y, c.texture_radius)), c.texture_radius)


def residuals(planes: np.ndarray, regime: Regime, c: RegimeConfig) -> tuple[np.ndarray, np.ndarray]:
    """((colour distortion, relative darkness), the brightness around): each cell's colours are its regime's times a
    brightness, but for the distortion; darkness is how far its brightness lies below that of its surroundings."""
    level, deviation = regime.levels[:3], np.maximum(np.sqrt(np.maximum(regime.spreads[:3], 0)), c.noise)
    own, known = planes / deviation, level / deviation
    brightness = (own * known).sum(0) / np.maximum((known * known).sum(0), 1e-6)
    distortion = np.sqrt(((own - brightness * known) ** 2).sum(0))
    around = box_mean(brightness, c.around_radius)
    return np.stack((distortion, np.maximum(0.0, around - brightness))), around


def judged(planes: np.ndarray, regime: Regime, c: RegimeConfig) -> tuple[int, int, str, np.ndarray]:
    """(clear blobs, cells of the largest one, the channel that fired, the residuals)."""
    seen, around = residuals(planes, regime, c)
    floors = np.array([c.colour_floor, c.dark_floor])[:, None, None]
    strange = (seen - regime.levels[3:]) / np.maximum(np.sqrt(regime.spreads[3:]), floors)
    # a shadow keeps its share of the texture, what stands before the background hides it
    lost = np.clip(1.0 - textured(planes, c) / (np.maximum(around, 0.05) * regime.detail + 1e-3), 0.0, 1.0)
    colour = strange[0] / c.colour_z
    dark = np.where((regime.detail <= c.texture) | (lost > c.hidden), strange[1], 0.0) / c.dark_z
    fired = box_mean(np.maximum(colour, dark), c.smooth_radius) > 1.0
    found = blobs.sizes(fired, True)
    clear = found[found >= c.least_area]
    channel = "-" if not fired.any() else "colour" if (colour > 1.0)[fired].mean() > 0.5 else "dark"
    return len(clear), int(clear.max(initial=0)), channel, seen


@dataclass
class Camera:
    """One device's regimes by number, the frame that shifts are measured against, and how often in a row it was off."""

    config: RegimeConfig
    regimes: dict[int, Regime] = field(default_factory=dict)
    named: int = 0
    reference: np.ndarray | None = None
    moved: int = 0

    def _found(self, planes: np.ndarray, descriptor: np.ndarray) -> int:
        self.regimes[self.named] = Regime.founded(planes, descriptor, self.config)
        self.named += 1
        if len(self.regimes) > self.config.most:
            order = sorted(self.regimes)
            apart = {(a, b): float(np.linalg.norm(self.regimes[a].descriptor - self.regimes[b].descriptor)) for k, a in enumerate(order) for b in order[k + 1 :]}
            a, b = min(apart, key=apart.get)
            self.regimes[a] = self.regimes[a].merged(self.regimes.pop(b))
        return self.named - 1

    def see(self, planes: np.ndarray, teaches: bool) -> tuple[int, float, float, int, int, str, str]:
        """(regime, its distance, shift, blobs, largest, channel, decision) of a frame, which may teach its regime then."""
        c, y = self.config, luma(planes)
        if y.mean() < c.night:
            return -1, 0.0, 0.0, 0, 0, "-", "NIGHT"
        descriptor = described(y)
        gaps = {k: float(np.linalg.norm(descriptor - r.descriptor)) for k, r in sorted(self.regimes.items())}
        own = min(gaps, key=gaps.get) if gaps else -1
        distance = gaps.get(own, float("inf"))
        ready = own >= 0 and self.regimes[own].count >= c.warmup
        shift = confidence = 0.0
        n, largest, channel, seen, decision = 0, 0, "-", np.zeros((2, *y.shape)), "WARMUP"
        if ready:
            if self.reference is not None:
                dy, dx, confidence = phase_shift(self.reference, y)
                shift = float(np.hypot(dy, dx))
            n, largest, channel, seen = judged(planes, self.regimes[own], c)
            rules = (
                (teaches and self.moved >= 1 and shift > c.bump, "BUMP"), (distance > c.novelty, "SCENE_EVENT"), (largest > c.big * y.size, "SCENE_EVENT"), (n >= 1, "BIRD_CANDIDATE"),
            )
            decision = next((name for holds, name in rules if holds), "BACKGROUND")
        if teaches:
            self._learn(planes, y, descriptor, own, distance, seen, shift, confidence, decision)
        return own, distance, shift, n, largest, channel, decision

    def _learn(self, planes, y, descriptor, own, distance, seen, shift, confidence, decision) -> None:
        c = self.config
        if shift > c.bump and confidence > c.confidence and self.reference is not None:
            self.moved += 1  # the old reference stands until the next timer frame confirms it
        else:
            self.moved, self.reference = 0, y
        if decision == "BUMP" and self.moved >= 2:
            self.regimes, self.moved, self.reference = {}, 0, y
            self._found(planes, descriptor)
        elif own < 0 or distance > c.near:
            self._found(planes, descriptor)
        else:
            self.regimes[own] = self.regimes[own].taught(planes, descriptor, seen, c)
