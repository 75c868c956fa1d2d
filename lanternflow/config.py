"""Every tunable of a run, once."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults of a run, and the names under which its metadata gives them.
@dataclass(frozen=True)
class RunConfig:
    video_path: str = ""
    weapon_model: str = ""
    detector_model: str = "yolo11n.pt"
    conf: float = 0.35
    device: str = "cpu"
    frame_stride: int = 1
    weapon_conf: float = 0.4
    weapon_proximity_norm: float = 0.15
    weapon_pad_ratio: float = 0.4
    weapon_confidence_threshold: float = 0.5
    weapon_min_duration_s: float = 0.15
    event_cooldown_s: float = 5.0
    weapon_max_gap_s: float = 0.15


# Class ids the detector is asked for (0 is a person, all others are vehicles); names that are no
# threat; the event's type; how long a banner stays; above-samples that a streak needs.
DETECTOR_CLASSES = (0, 2, 3, 5, 7)
NON_THREAT_NAMES = ("person", "hand", "phone")
EVENT_TYPE = "weapon"
BANNER_LOOKBACK_S = 3.0
MIN_SAMPLES = 2
DEFAULT = RunConfig()
