"""Parameters of all stages with their defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    # segmentation
    br_threshold: float = 120.0
    cont_threshold: float = 5.0
    cell_radius: int = 5
    # motion
    brightness_threshold: float = 120.0
    grid_radius: int = 30
    um_per_pixel: float = 0.406
    single_plane_cycle: int = 150
    # extraction
    enable_detrending: bool = True
    detrend_window_frames: int = 600
    detrend_percentile: float = 15.0
    detrend_offset: float = 10.0
    enable_photobleach_fit: bool = False
    baseline_window_seconds: float = 180.0
    enable_remove_duplicates: bool = False
    dedup_corr_threshold: float = 0.7
    enable_motion_filter: bool = False
    motion_threshold_pixels: float = 1.0
    test_minutes: float | None = None
    # batch
    skip_segmentation: bool = False
    skip_motion: bool = False
    force_rerun: bool = False
    #: Accepted and without effect: Spark decides where the work runs.
    use_gpu: bool = False
    #: "reference" lets stencils wrap between columns of the linear index, "strict" does not.
    edge_mode: str = "reference"

    def digest(self) -> str:
        """Names outputs: results of other parameters are never taken for these."""
        own = {k: v for k, v in asdict(self).items() if k not in ("force_rerun", "skip_segmentation", "skip_motion", "use_gpu")}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:12]

    def suffix(self) -> str:
        """Names options that are not the default, in a fixed order."""
        return (
            "_expfit" * self.enable_photobleach_fit
            + "_nodetrend" * (not self.enable_detrending)
            + "_dedup" * self.enable_remove_duplicates
            + "_motionfiltered" * self.enable_motion_filter
        )
