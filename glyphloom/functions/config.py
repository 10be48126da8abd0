"""Settings of a run: profiles, validation before anything is planned."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    detector_size: int = 1024
    detector_batch: int = 1
    recognition_batch: int = 128
    inflight: int = 4
    page_orientation: bool = False
    deskew: bool = False
    dense_refinement: bool = False
    thin_recovery: bool = False
    line_guided: bool = False
    bin_thresh: float = 0.3
    box_thresh: float = 0.1
    unclip_ratio: float = 1.5

    def checked(self) -> Settings:
        """Itself, or an error that names what is wrong."""
        if self.detector_size < 32 or self.detector_size % 32:
            raise ValueError("detector_size: a multiple of 32, 32 at least")
        for name in ("detector_batch", "recognition_batch", "inflight"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name}: 1 at least")
        if self.deskew and not self.page_orientation:
            raise ValueError("deskew needs page_orientation")
        if not (0 < self.bin_thresh < 1 and 0 <= self.box_thresh <= 1 and self.unclip_ratio >= 0):
            raise ValueError("thresholds are out of their range")
        return self


PROFILES = {"balanced": Settings(), "low-vram": Settings(recognition_batch=32, inflight=2)}


def settings(profile: str = "balanced", **changes: Any) -> Settings:
    """A profile with changes; unknown profiles and names are errors."""
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    if unknown := sorted(set(changes) - {f.name for f in fields(Settings)}):
        raise ValueError(f"no such setting: {', '.join(unknown)}")
    return replace(PROFILES[profile], **changes).checked()
