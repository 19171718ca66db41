"""Feature names, profiles and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

# Names and order of the features, and which of them each step uses.
FEATURES = (
    "dominant_freq_hz", "spectral_power_in_band", "spectral_snr", "spectral_entropy", "harmonic2_ratio", "freq_stability_std",
    "interval_cv", "stroke_amp_cv", "rise_fall_ratio", "rise_time_cv", "fall_time_cv", "autocorr_at_period", "cycle_shape_cv", "cycle_corr_mean",
    "phase_portrait_eccentricity", "envelope_cv", "top_bot_corr", "left_right_corr", "quadrant_cv_max", "active_roi_fraction", "motion_cv",
    "flow_dom_freq", "freq_flow_diff",
)
LIVE_FEATURES = tuple(f for f in FEATURES if f not in ("harmonic2_ratio", "phase_portrait_eccentricity", "flow_dom_freq", "freq_flow_diff"))
SELECTED = (
    "dominant_freq_hz", "spectral_power_in_band", "spectral_entropy", "freq_stability_std", "interval_cv", "stroke_amp_cv", "rise_fall_ratio",
    "fall_time_cv", "autocorr_at_period", "cycle_corr_mean", "envelope_cv", "top_bot_corr", "quadrant_cv_max", "motion_cv",
)
META = ("file", "pump_start_s", "pump_end_s", "pump_dur_s", "roi_x1", "roi_y1", "roi_x2", "roi_y2")
KEEP_OF_PAIR = ("dominant_freq_hz", "autocorr_at_period")
# What figures call the features.
PRETTY = {
    "dominant_freq_hz": "Dominant Frequency (Hz)",
    "spectral_power_in_band": "Spectral Band Power",
    "spectral_snr": "Spectral SNR",
    "spectral_entropy": "Spectral Entropy",
    "freq_stability_std": "Frequency Stability",
    "interval_cv": "Stroke Interval CV",
    "stroke_amp_cv": "Stroke Amplitude CV",
    "rise_fall_ratio": "Rise/Fall Ratio",
    "rise_time_cv": "Rise Time CV",
    "fall_time_cv": "Fall Time CV",
    "autocorr_at_period": "Autocorr. at Period",
    "cycle_shape_cv": "Cycle Shape CV",
    "cycle_corr_mean": "Cycle Correlation",
    "phase_portrait_eccentricity": "Phase Eccentricity",
    "envelope_cv": "Envelope CV",
    "top_bot_corr": "Top-Bottom Corr.",
    "left_right_corr": "Left-Right Corr.",
    "quadrant_cv_max": "Quadrant CV (Max)",
    "active_roi_fraction": "Active ROI Fraction",
    "motion_cv": "Motion CV",
}
MODELS = ("mahalanobis", "lof", "isoforest", "elliptic_envelope", "ocsvm")

#: Guards of divisions and logarithms.
EPS, LOG_EPS = 1e-9, 1e-12
VOTES, NEAR_CONSTANT, SAME_PAIR, LEAST_IMPORTANCE, LOO_PERCENTILE = 3, 0.95, 0.95, 0.05, 0.99


@dataclass(frozen=True)
class Profile:
    """How clips become signals and features. The numbers are fixed values."""

    fps: float = 30.0
    least_frames: int = 60
    least_sharpness: float = 25.0
    sharpness_every: int = 300
    on_off_threshold: int = 15
    active_share: float = 0.05
    threshold_factor: float = 0.25
    least_threshold: int = 20
    persist: int = 6
    peak_distance_s: float = 0.07
    peak_prominence: float = 0.35
    window_s: float = 4.0
    step_s: float = 0.5
    low_hz: float = 1.0
    high_hz: float = 20.0
    mask_factor: float = 0.5


@dataclass(frozen=True)
class Sessions:
    """When a recording starts and ends. The numbers are fixed values."""

    fps: float = 30.0
    on_off_threshold: int = 15
    least_pixels: int = 60
    confirm: int = 5
    gap_s: float = 4.0
    longest_s: float = 180.0
    cooldown_s: float = 1.0
    before_s: float = 10.0


OFFLINE = Profile()
LIVE = Profile(least_sharpness=20.0, least_threshold=15, persist=5)
