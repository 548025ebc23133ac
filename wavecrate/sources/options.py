"""Options of a job, with their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Loudness targets by what is measured.
TARGETS = {"short_term": -14.0, "integrated": -16.0}
STEPS = ("fix_names", "sort", "bpm_key", "loudness")


@dataclass(frozen=True)
class Options:
    """The steps that run, the loudness they aim at, and the services that are asked."""

    steps: frozenset[str] = frozenset(STEPS)
    loudness_mode: str = "short_term"
    target: float = TARGETS["short_term"]
    safe_limiter: bool = True
    remove_silence: bool = False
    add_prefix: bool = False
    output_format: str = "wav"
    sample_rate: str = "original"
    use_recordings: bool = False
    use_releases: bool = False
    top_tags_key: str = ""

    def anything_to_do(self) -> bool:
        """Whether a step is on."""
        return bool(self.steps & set(STEPS))

    def looks_up(self) -> bool:
        return self.use_recordings or self.use_releases or bool(self.top_tags_key)


def read_options(given: dict) -> Options:
    """Options from a form's values; a target that is no number gets its mode's default, and converting alone aims at nothing."""
    mode = given.get("loudness_mode", Options.loudness_mode)
    try:
        target = float(given.get("target"))
    except (TypeError, ValueError):
        target = math.nan
    if not math.isfinite(target):
        target = TARGETS["short_term" if mode == "short_term" else "integrated"]
    plain = {k: given[k] for k in ("safe_limiter", "remove_silence", "add_prefix", "output_format", "sample_rate", "use_recordings", "use_releases") if k in given}
    return Options(frozenset(given.get("steps", STEPS)), mode, 0.0 if mode == "convert_only" else target, top_tags_key=str(given.get("top_tags_key", "")).strip(), **plain)
