"""Thresholds, in milliseconds, decibels and ratios unless named otherwise. Every operator takes them as parameters."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Candidates:
    max_join_gap_ms: int = 500
    min_inference_ms: int = 1500
    max_clip_ms: int = 30_000


@dataclass(frozen=True)
class Scoring:
    """A window's rejections, penalties and tiers."""

    min_duration: int = 1200
    min_ratio: float = 0.65
    min_loudness: float = -50.0
    short: tuple = ((2000, 3000, 5.0), (1200, 2000, 15.0))
    ratio: tuple = ((0.75, 0.85, 8.0), (0.65, 0.75, 18.0))
    deviation: tuple = ((8.0, 12.0, 8.0), (12.0, 16.0, 18.0), (16.0, float("inf"), 30.0))
    edge_silence: int = 80
    edge_penalty: float = 3.0
    flag_penalties: tuple = (("tiny_interval", 15.0), ("low_speech_ratio", 18.0), ("unstable_loudness", 10.0), ("rms_vad_fallback_no_overlap_detection", 10.0))
    tiers: tuple = ((80.0, "clean"), (65.0, "usable"), (50.0, "weak"))
    gold_weights: tuple = (("clean", 1.0), ("usable", 0.70))


@dataclass(frozen=True)
class Timeline:
    edge_trim_ms: int = 200
    join_gap_ms: int = 500
    tiny_ms: int = 1200
    low_ratio: float = 0.75
    unstable_db: float = 10.0
    chunk_ms: int = 10_000
    hop_ms: int = 5_000
    context_ms: int = 2_500
    frame_ms: int = 30
    silence_db: float = -90.0
    speech_db: float = -45.0


def timeline_of(profile: dict) -> Timeline:
    """A request's profile over the defaults: values that are missing or 0 don't count, and the join gap falls back from the
    candidate's section to the clean window's."""
    own, clean = (profile.get(k) if isinstance(profile.get(k), dict) else {} for k in ("speech_window_candidate", "clean_window"))
    d = Timeline()
    return replace(
        d, edge_trim_ms=int(own.get("edge_trim_ms") or d.edge_trim_ms), tiny_ms=int(own.get("min_trimmed_ms") or d.tiny_ms), join_gap_ms=int(own.get("max_join_gap_ms") or clean.get("max_join_gap_ms") or d.join_gap_ms),
        low_ratio=float(own.get("min_speech_ratio") or d.low_ratio), unstable_db=float(own.get("max_loudness_std_db") or d.unstable_db),
    )


@dataclass(frozen=True)
class Clusters:
    """Neighbour counts, selection weights, limits."""

    neighbours: tuple = (1, 2, 3, 5, 8)
    max_k: int = 6
    one_speaker_cosine: float = 0.62
    dense_limit: int = 1024
    lanczos_steps: int = 200
    lanczos_basis: int = 90
    concentration_weight: float = 0.85
    nearest_weight: float = 0.75
    intra_weight: float = 0.95
    deviation_weight: float = 0.04
    core_q: float = 0.70
    boundary_q: float = 0.90
    medoid_slack: float = 0.02
    iterations: int = 80


@dataclass(frozen=True)
class Assignment:
    """Relative margins of the strict levels, limits of the recall."""

    strong: float = 0.35
    normal: float = 0.20
    tentative: float = 0.12
    slack: float = 1e-9
    hard_cap: float = 0.70
    near: float = 0.62
    over_radius: float = 0.08
    low_relative: float = 0.10
    low_margin: float = 0.04
    high_relative: float = 0.18
    high_margin: float = 0.08
    poor_ms: int = 2000
    poor_ratio: float = 0.45
    poor_deviation: float = 18.0
    poor_loudness: float = -55.0
    good_ms: int = 5000
    good_ratio: float = 0.65
    good_deviation: float = 12.0
    far: float = 0.42
    quiet: float = -50.0
    weak_margin: float = 0.08
    weak_purity: float = 0.30
    weak_concentration: float = 0.60


@dataclass(frozen=True)
class Evaluation:
    frame_ms: int = 100
    collar_ms: int = 250
    unknown: str = "unknown"
    min_recordings: int = 20
    min_minutes: int = 60
    scenarios: tuple = ("single_speaker", "two_speaker", "multi_speaker", "overlap", "noisy_or_far_field")
    per_scenario: int = 3
    #: metric, operator, threshold
    gates: tuple = (("der", "<=", 0.30), ("jer", "<=", 0.40), ("speaker_count_exact", ">=", 0.80), ("speaker_count_mae", "<=", 0.30), ("assigned_accuracy", ">=", 0.85), ("coverage", ">=", 0.80), ("unknown_rate", "<=", 0.20))


@dataclass(frozen=True)
class Packing:
    windows: int = 16
    seconds: float = 60.0
    bytes: int = 32 * 1024 * 1024


@dataclass(frozen=True)
class Tasks:
    retention_ms: int = 24 * 3600 * 1000
    expired_metadata_ms: int = 24 * 3600 * 1000
    terminal: tuple = ("succeeded", "failed", "cancelled")


@dataclass(frozen=True)
class Params:
    candidates: Candidates = field(default_factory=Candidates)
    scoring: Scoring = field(default_factory=Scoring)
    timeline: Timeline = field(default_factory=Timeline)
    clusters: Clusters = field(default_factory=Clusters)
    assignment: Assignment = field(default_factory=Assignment)
    evaluation: Evaluation = field(default_factory=Evaluation)
    packing: Packing = field(default_factory=Packing)
    tasks: Tasks = field(default_factory=Tasks)

    def digest(self) -> str:
        """SHA-256 of the values as compact JSON with sorted keys."""
        return canonical_digest(asdict(self))


def canonical_digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def merged(base: dict, overlay: dict, locked: tuple = ()) -> dict:
    """overlay over base, key by key in nested objects; other values replace. Locked sections may not be named."""
    if bad := set(overlay) & set(locked):
        raise ValueError(f"locked: {sorted(bad)}")
    out = copy.deepcopy(base)
    for k, v in overlay.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: Sections that an overlay may change.
OVERRIDABLE = ("components", "exports", "failure_policy", "input", "runtime")


def load_config(base: dict, overlay: dict | None = None) -> dict:
    """base (which needs schema_version 1 and a section algorithm) with an overlay, which may name OVERRIDABLE sections only."""
    if int(base.get("schema_version") or 0) != 1 or not isinstance(base.get("algorithm"), dict):
        raise ValueError("CONFIG_INVALID")
    if extra := sorted(set(overlay or {}) - set(OVERRIDABLE)):
        raise ValueError(f"CONFIG_LOCKED_OVERRIDE: {', '.join(extra)}")
    out = merged(base, overlay or {})
    if "runtime" in base:
        target, hard = (float(out["runtime"].get(c) or 0.0) for c in ("memory_target_ratio", "memory_hard_limit_ratio"))
        if {"memory_target_ratio", "memory_hard_limit_ratio"} & set(out["runtime"]) and not 0.0 < target < hard <= 1.0:
            raise ValueError("CONFIG_INVALID: memory ratios must satisfy 0 < target < hard <= 1")
    return out


def read_config(path: str, overlay: str | None = None, urls: dict[str, str] | None = None) -> dict:
    """load_config() of files, JSON or (where PyYAML is installed) YAML. A file that isn't there, can't be read or holds no object
    is CONFIG_INVALID. urls: addresses by component, in place of the files'; addresses lose slashes at their end. A relative
    runtime.temporary_root is one beside the file."""

    def read(name: str) -> dict:
        try:
            with open(name, encoding="utf-8") as f:
                text = f.read()
            try:
                found = json.loads(text)
            except ValueError:
                import yaml

                found = yaml.safe_load(text)
        except Exception as e:  # noqa: BLE001  whatever the parser raises
            raise ValueError(f"CONFIG_INVALID: {os.path.basename(name)}: {type(e).__name__}") from e
        if not isinstance(found, dict):
            raise ValueError(f"CONFIG_INVALID: {os.path.basename(name)}")
        return found

    out = load_config(read(path), read(overlay) if overlay else None)
    for name, component in out.get("components", {}).items():
        if isinstance(component, dict) and (url := (urls or {}).get(name) or component.get("base_url")):
            component["base_url"] = url.rstrip("/")
    if root := out.get("runtime", {}).get("temporary_root"):
        out["runtime"]["temporary_root"] = os.path.abspath(os.path.join(os.path.dirname(os.path.abspath(path)), root))
    return out


def snapshot(config: dict, public) -> dict:
    """What a result says about its configuration: digests, and the overridable sections as public(value) shows them."""
    sections = {k: public(config[k]) for k in OVERRIDABLE if k in config}
    return {"schema_version": config["schema_version"], "effective_digest": canonical_digest(config), "algorithm_digest": canonical_digest(config["algorithm"]), **sections}
