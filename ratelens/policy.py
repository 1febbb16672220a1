"""Fixed values of the domain and the three analysis profiles."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results depend on these being exactly as they are. ---------
CONTAINER_FACTOR = 0.98
DEFAULT_TARGET_RATIO = {"hevc": 0.76, "av1": 0.64}
DEFAULT_MAX_OUTPUT_RATIO = {"hevc": 0.70, "av1": 0.50}
MIN_TARGET_BPS = 50_000
BITRATE_STEP = 1_000
MAX_TRIALS = 8
TEMPORAL_DROP_TOLERANCE = 4.0
SHOT_MEAN_FLOOR_DROP = 4.0
SHOT_WORST_FLOOR_DROP = 8.0
SCENE_CHANGE_THRESHOLD = 10.0
NEUTRAL_LUMA = 128.0
HFR_MIN_FPS = 50.0
WINDOW_EPSILON = 1e-9
UNIT_HASH_PREFIX = "smart-strata-v1"
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
BITMAP_SUBTITLE_CODECS = ("dvd_subtitle", "dvbsub", "dvb_teletext", "hdmv_pgs_subtitle", "xsub")
EIGHT_BIT_PIXEL_FORMATS = (
    "yuv420p", "yuv422p", "yuv444p", "yuvj420p", "yuvj422p", "yuvj444p", "nv12", "nv21", "rgb24", "bgr24",
)
TEN_BIT_PIXEL_FORMATS = ("p010", "p010le", "p010be", "p210", "p210le", "p210be")
SUFFIX_BIT_DEPTHS = (9, 10, 12, 14, 16)
VIDEO_EXTENSIONS = (
    ".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".ts", ".m2ts", ".mts", ".mpg", ".mpeg",
    ".3gp", ".ogv",
)
SIDECAR_EXTENSIONS = (
    ".srt", ".ass", ".ssa", ".vtt", ".sub", ".idx", ".sup", ".ttml", ".dfxp", ".smi", ".sami", ".usf",
)
QUALITY_MODELS = {
    (False, False): "vmaf_v1.0.16_3d0h",
    (False, True): "vmaf_v1.0.16_hfr_3d0h",
    (True, False): "vmaf_v1.0.16_1d5h_2160",
    (True, True): "vmaf_v1.0.16_hfr_1d5h_2160",
}
COUNTERS = (
    "scout_windows", "quality_encodes", "vmaf_measurements", "holdout_measurements", "size_calibration_encodes",
)
RISK_WEIGHTS = {
    "spatial_detail": 0.27,
    "motion": 0.30,
    "transition": 0.17,
    "dark": 0.08,
    "flat_or_gradient": 0.08,
    "high_frequency_or_noise": 0.10,
}
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Sampling and search limits. Defaults are the "balance" profile (fixed values)."""

    whole_video_max_sec: float = 20.0
    scout_duration_sec: float = 2.0
    scout_multiplier: int = 4
    scout_max_windows: int = 32
    sample_duration_sec: float = 5.0
    counts_by_length: tuple[int, int, int, int] = (4, 5, 6, 6)  # <10 min, <60, <=180, longer
    holdouts: tuple[int, int] = (2, 2)  # up to 180 min, longer
    search_windows: tuple[int, int] = (3, 6)  # min, max
    holdout_target: tuple[int, int] = (1, 2)  # min, max
    reserves: int = 2
    min_tolerance_bps: int = 50_000
    tolerance_ratio: float = 0.03
    preferred_margin: float = 0.4
    confidence_band: float = 0.7
    shot_search_windows: int = 2
    shot_window_sec: float = 2.0
    shot_candidates: int = 5


# Fixed values.
PROFILES = {
    "fast": Profile(
        whole_video_max_sec=12.0, scout_duration_sec=1.5, scout_multiplier=3, scout_max_windows=12,
        sample_duration_sec=4.0, counts_by_length=(3, 3, 4, 4), holdouts=(1, 1), search_windows=(2, 4),
        holdout_target=(1, 1), reserves=1, min_tolerance_bps=100_000, tolerance_ratio=0.06, preferred_margin=0.2,
        shot_search_windows=1, shot_window_sec=2.0, shot_candidates=3,
    ),
    "balance": Profile(),
    "precise": Profile(
        whole_video_max_sec=30.0, scout_duration_sec=2.5, scout_multiplier=6, scout_max_windows=64,
        sample_duration_sec=6.0, counts_by_length=(6, 7, 8, 10), holdouts=(3, 4), search_windows=(4, 10),
        holdout_target=(2, 4), reserves=4, min_tolerance_bps=25_000, tolerance_ratio=0.015, preferred_margin=0.5,
        shot_search_windows=3, shot_window_sec=3.0, shot_candidates=7,
    ),
}
BALANCE = PROFILES["balance"]

# States per shot that the profiles of a per-shot allocation keep, where a limit is wanted.
STATE_LIMITS = {"fast": 2048, "balance": 8192, "precise": 16384}
