"""From detections to events: which vehicles had a sustained, nearby threat, when, and who contributed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lanternflow.config import DEFAULT, RunConfig
from lanternflow.operators import debounce, detect, gate, scene, score


@dataclass(frozen=True)
class Detections:
    """The plan over tracked objects and raw model boxes; every stage is a lazy DataFrame."""

    objects: DataFrame
    raw: DataFrame
    config: RunConfig = DEFAULT

    @property
    def persons(self) -> DataFrame:
        return detect.split_classes(self.objects)[0]

    @property
    def vehicles(self) -> DataFrame:
        return detect.split_classes(self.objects)[1]

    @property
    def crops(self) -> DataFrame:
        """Crops of gated persons: what a model would be shown."""
        return detect.crop_windows(gate.gated(self.persons, self.vehicles, self.config.weapon_proximity_norm), self.config.weapon_pad_ratio)

    @property
    def nearest(self) -> DataFrame:
        return gate.nearest_gated(self.persons, self.vehicles, self.config.weapon_proximity_norm)

    @property
    def scenes(self) -> DataFrame:
        """Whole frames: objects and boxes are each shuffled once, by (clip, frame), for all that follows."""
        return scene.scenes(self.objects, self.raw, self.config)

    @property
    def matched(self) -> DataFrame:
        """Each gated person's best threat with the nearest vehicle."""
        return scene.matched(self.scenes)

    @property
    def hits(self) -> DataFrame:
        return self.matched.select("clip_id", "frame_idx", "person_track_id", "confidence", "bbox")

    @property
    def by_vehicle(self) -> DataFrame:
        return score.group_hits(self.matched)

    @property
    def samples(self) -> DataFrame:
        return scene.samples(self.scenes, self.config.weapon_confidence_threshold)

    @property
    def events(self) -> DataFrame:
        return debounce.debounce(self.samples, debounce.Thresholds.of(self.config))
