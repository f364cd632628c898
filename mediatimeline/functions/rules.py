"""First-match rule classifiers as single column expressions.

Each classifier is a list of (condition, label, confidence) rows, so the whole ladder compiles
into one CASE inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Levels:
    """Default thresholds of the signal classifiers (fixed values)."""

    high_energy: float = 0.3
    medium_energy: float = 0.15
    high_centroid: float = 3000.0
    medium_centroid: float = 2000.0
    low_centroid: float = 1500.0
    high_zcr: float = 0.15
    medium_zcr: float = 0.1
    energy_change: float = 0.5
    voice_energy_change: float = 0.15
    key_change: float = 0.4


LEVELS = Levels()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule that holds."""
    (condition, value), *rest = rules
    case = F.when(condition, value)
    for condition, value in rest:
        case = case.when(condition, value)
    return case.otherwise(default)


def _verdict(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def ladder(rules: list[tuple[Column, str, float]], default: tuple[str, float]) -> Column:
    """struct(label, confidence) of the first rule that holds."""
    return first_match([(c, _verdict(label, conf)) for c, label, conf in rules], _verdict(*default))


def classify_sound(energy="energy", centroid="centroid", zcr="zcr", p: Levels = LEVELS) -> Column:
    e, c, z = _col(energy), _col(centroid), _col(zcr)
    return ladder([
        ((e > p.high_energy) & (c > p.high_centroid), "high_frequency_transient", 0.8),
        ((e > p.medium_energy * 1.33) & (z > p.high_zcr) & (c <= p.high_centroid), "noisy_transient", 0.75),
        ((e > p.medium_energy) & (c < p.low_centroid) & (z <= p.high_zcr), "low_frequency_impact", 0.7),
        ((c > p.medium_centroid) & (c <= p.high_centroid) & (z > p.medium_zcr) & (e <= p.high_energy), "speech", 0.75),
        ((e > p.medium_energy * 0.67) & (e <= p.medium_energy) & c.between(p.low_centroid, p.medium_centroid),
         "music", 0.7),
    ], ("background", 0.5))


def classify_emotion(energy="energy", zcr="zcr", f0="f0", p: Levels = LEVELS) -> Column:
    e, z, f = _col(energy), _col(zcr), _col(f0)
    return ladder([
        ((e > p.medium_energy * 1.33) & (f > 200), "excited", 0.8),
        ((e > p.medium_energy) & (z > p.medium_zcr * 1.2), "animated", 0.75),
        (e < p.voice_energy_change * 0.33, "calm", 0.7),
        (f > 250, "stressed", 0.65),
        (z > p.high_zcr * 1.33, "tense", 0.6),
    ], ("neutral", 0.8))


def classify_genre(energy="energy", centroid="centroid", rolloff="rolloff", p: Levels = LEVELS) -> Column:
    e, c, r = _col(energy), _col(centroid), _col(rolloff)
    return ladder([
        ((c > p.high_centroid) & (e > p.medium_energy * 0.67), "speech", 0.85),
        ((r < p.high_centroid) & (e > p.medium_energy), "rock", 0.75),
        ((c < p.medium_centroid) & (e < p.medium_energy * 1.33), "classical", 0.7),
        (c > (p.medium_centroid + p.high_centroid) / 2, "pop", 0.65),
        (e > p.medium_energy * 1.33, "electronic", 0.6),
    ], ("ambient", 0.55))


def music_rules(facet: str, energy="energy", centroid="centroid", rolloff="rolloff", zcr="zcr", tempo="tempo"):
    """(rules, default) of one facet; each outcome is (label, confidence, other probabilities)."""
    e, c, r, z, t = _col(energy), _col(centroid), _col(rolloff), _col(zcr), _col(tempo)
    if facet == "genre":
        return [
            ((e > 0.4) & (c > 3000) & (t > 140), ("electronic", 0.7, {"electronic": 0.7, "rock": 0.2, "pop": 0.1})),
            ((e > 0.3) & (r < 4000) & (t > 120), ("rock", 0.6, {"rock": 0.6, "pop": 0.3, "alternative": 0.1})),
            ((c < 2000) & (t < 80), ("classical", 0.6, {"classical": 0.6, "ambient": 0.3, "jazz": 0.1})),
            ((e > 0.2) & (t > 100) & (t < 130), ("pop", 0.5, {"pop": 0.5, "rock": 0.3, "indie": 0.2})),
        ], ("ambient", 0.4, {"ambient": 0.4, "unknown": 0.6})
    if facet == "mood":
        return [
            ((e > 0.4) & (t > 130), ("energetic", 0.7, {"energetic": 0.7, "happy": 0.2, "uplifting": 0.1})),
            ((e < 0.2) & (t < 90), ("calm", 0.6, {"calm": 0.6, "peaceful": 0.3, "relaxed": 0.1})),
            ((c < 1500) & (t < 70), ("melancholic", 0.5, {"melancholic": 0.5, "sad": 0.3, "dark": 0.2})),
            ((e > 0.3) & (t > 110) & (t < 140), ("happy", 0.6, {"happy": 0.6, "uplifting": 0.3, "bright": 0.1})),
        ], ("neutral", 0.4, {"neutral": 0.4, "unknown": 0.6})
    if facet == "instruments":
        return [
            ((c > 4000) & (e > 0.3), ("electronic, synthesizer", 0.6, {"electronic": 0.4, "synthesizer": 0.2})),
            ((c > 2000) & (c < 3500) & (e > 0.2), ("guitar, vocals", 0.5, {"guitar": 0.3, "vocals": 0.2})),
            ((c < 2000) & (r > 3000), ("bass, drums", 0.5, {"bass": 0.3, "drums": 0.2})),
            (c < 1500, ("piano, strings", 0.4, {"piano": 0.2, "strings": 0.2})),
        ], ("unknown", 0.3, {"unknown": 0.7})
    if facet == "style":
        return [
            ((z < 0.05) & (c < 2000), ("acoustic", 0.6, {"acoustic": 0.6, "organic": 0.3, "live_recording": 0.1})),
            ((z > 0.15) & (c > 3000),
             ("electronic", 0.7, {"electronic": 0.7, "synthetic": 0.2, "studio_recording": 0.1})),
            (e > 0.4, ("live_recording", 0.5, {"live_recording": 0.5, "band": 0.3, "energetic": 0.2})),
        ], ("studio_recording", 0.4, {"studio_recording": 0.4, "produced": 0.3, "clean": 0.3})
    raise ValueError(f"unknown facet {facet!r}")


def _probabilities(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def classify_music(facet: str, **columns) -> Column:
    """struct(label, confidence, probabilities) for genre, mood, instruments or style."""
    def outcome(label, confidence, table):
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"),
                        _probabilities(table).alias("probabilities"))
    rules, default = music_rules(facet, **columns)
    return first_match([(c, outcome(*o)) for c, o in rules], outcome(*default))


# Base probabilities of the sound-effect rules (fixed values).
SFX_BASE = {"high_frequency_sound": 0.1, "transient_sound": 0.1, "low_frequency_sound": 0.1, "background": 0.7}


def classify_sfx(energy="energy", zcr="zcr", centroid="centroid") -> Column:
    """struct(label, confidence, probabilities); the chosen label's probability is its confidence."""
    e, z, c = _col(energy), _col(zcr), _col(centroid)
    verdict = ladder([
        ((e > 0.3) & (c > 3000), "high_frequency_sound", 0.6),
        ((e > 0.15) & (z > 0.15), "transient_sound", 0.5),
        ((e > 0.1) & (c < 1000), "low_frequency_sound", 0.4),
    ], ("background", 0.3))
    table = F.transform_values(
        _probabilities(SFX_BASE), lambda k, v: F.when(k == verdict["label"], verdict["confidence"]).otherwise(v))
    return F.struct(verdict["label"].alias("label"), verdict["confidence"].alias("confidence"),
                    table.alias("probabilities"))


def onset_character(centroid="centroid", energy="energy", sample_rate: float = 22050.0, p: Levels = LEVELS) -> Column:
    c, e = _col(centroid), _col(energy)
    bands = [
        (c > sample_rate * 0.136, 0.6, "Sharp percussive hit with bright timbre", "Subtle high-frequency accent"),
        (c > sample_rate * 0.068, 0.4, "Strong musical accent with warm timbre", "Gentle melodic emphasis"),
        (F.lit(True), 0.5, "Deep bass accent or drum hit", "Soft low-frequency musical event"),
    ]
    phrase = [(band, F.when(e > p.energy_change * share, loud).otherwise(soft)) for band, share, loud, soft in bands]
    return first_match(phrase, F.lit(None).cast("string"))


def texture(harmonic_ratio="harmonic_ratio", p: Levels = LEVELS) -> Column:
    h = _col(harmonic_ratio)
    # The two cut-offs are sums of settings in the sentence form; as numbers they are .7 and .3.
    return first_match([(h > 0.7, F.lit("melodic")), (h < 0.3, F.lit("percussive"))], F.lit("mixed"))


def intensity(energy="energy") -> Column:
    e = _col(energy)
    return first_match([(e > 0.3, F.lit("high")), (e > 0.15, F.lit("moderate"))], F.lit("low"))


def section_sentence(harmonic_ratio="harmonic_ratio", energy="energy", duration="duration", tempo="tempo",
                     p: Levels = LEVELS) -> Column:
    """One-line description of a structural section."""
    e = _col(energy)
    level = first_match([
        (e > p.energy_change * 0.6, F.lit("high energy")),
        (e > p.energy_change * 0.3, F.lit("moderate energy")),
    ], F.lit("low energy"))
    return F.format_string("%s section (%.1fs) - %s, %.0f BPM", F.initcap(texture(harmonic_ratio, p)),
                           _col(duration), level, _col(tempo))


def energy_category(energy="energy", p: Levels = LEVELS) -> Column:
    e = _col(energy)
    return first_match([(e > p.high_energy, F.lit("high")), (e > p.medium_energy * 0.67, F.lit("medium"))],
                       F.lit("low"))


# Fixed word lists of the text rules.
CUE_WORDS = ("person", "object", "text", "environment", "interaction", "activity")
DOUBT_WORDS = ("error", "failed", "unavailable", "unclear")


def text_confidence(text="text", cues: tuple[str, ...] = CUE_WORDS, doubts: tuple[str, ...] = DOUBT_WORDS) -> Column:
    raw = _col(text)
    low = F.lower(raw)
    hits = sum((low.contains(w).cast("int") for w in cues), F.lit(0))
    score = F.lit(0.5) + F.when(F.length(raw) > 100, 0.2).otherwise(0.0) + F.least(F.lit(0.3), hits * 0.05)
    doubtful = F.lit(False)
    for w in doubts:
        doubtful = doubtful | low.contains(w)
    score = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.when(doubtful, score * 0.5).otherwise(score)))
    return F.when(raw.isNull() | (F.length(raw) < 20), F.lit(0.2)).otherwise(score)


def _first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit("")).cast("double")


def _unit_scale(number: Column) -> Column:
    return F.when(number <= 1.0, number).otherwise(number / 100.0)


def scene_similarity(response="text") -> Column:
    """Similarity read from a same-scene answer."""
    r = _col(response)
    same = F.coalesce(_unit_scale(_first_number(r)), F.lit(0.8))
    return F.when(F.upper(r).contains("SAME_SCENE"), same).otherwise(F.lit(0.2))


def frame_similarity(response="text") -> Column:
    """Similarity read from a scored answer, by keyword where it holds no number."""
    r = _col(response)
    low = F.lower(r)
    words = first_match([
        (low.contains("identical") | low.contains("very similar"), F.lit(0.9)),
        (low.contains("similar"), F.lit(0.7)),
        (low.contains("different"), F.lit(0.3)),
    ], F.lit(0.5))
    return F.coalesce(_unit_scale(_first_number(r)), words)


def is_artifact_text(description="description") -> Column:
    """Would this event, heard during speech, be an artifact of the speech?"""
    d = F.lower(_col(description))
    def any_of(*words):
        return d.rlike("|".join(words))
    return first_match([
        (any_of("musical onset", "harmonic shift"), F.lit(True)),
        (any_of("spectral", "frequency", "timbre"), F.lit(True)),
        (any_of("tempo", "structural", "rhythm"), F.lit(False)),
    ], F.lit(True))


# Keyword ladders per pipeline stage (fixed values): error type, keywords.
ERROR_LADDERS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "ffmpeg": (
        ("ffmpeg_format", ("unsupported", "format", "codec")),
        ("ffmpeg_corrupted", ("corrupted", "invalid", "damaged")),
        ("ffmpeg_space", ("space", "disk full", "no space")),
        ("ffmpeg_permission", ("permission", "access denied")),
    ),
    "gpu": (
        ("gpu_memory", ("out of memory", "cuda memory", "oom")),
        ("gpu_model_loading", ("model", "loading", "checkpoint")),
        ("gpu_cuda_driver", ("cuda", "driver", "device")),
    ),
    "scene": (
        ("scene_no_detection", ("no scenes", "zero scenes")),
        ("scene_threshold", ("threshold",)),
        ("scene_too_short", ("too short", "duration")),
    ),
    "coarse": (
        ("gpu_error", ("cuda", "gpu", "memory", "oom")),
        ("ffmpeg_error", ("ffmpeg", "codec", "format")),
        ("scene_error", ("scene",)),
        ("filesystem_error", ("permission", "access", "file")),
    ),
}


def classify_error(message="message", ladder_name: str = "coarse", ladders=None) -> Column:
    m = F.lower(_col(message))
    steps = (ladders or ERROR_LADDERS)[ladder_name]
    default = "unknown_error" if ladder_name == "coarse" else "unknown"
    return first_match([(m.rlike("|".join(words)), F.lit(kind)) for kind, words in steps], F.lit(default))


# Decision table (fixed values): stage, error type (None = any other), success, action.
RECOVERY = (
    ("ffmpeg_extraction", "ffmpeg_format", True, "parameter_adjust"),
    ("ffmpeg_extraction", "ffmpeg_space", True, "retry"),
    ("ffmpeg_extraction", None, False, "skip_video"),
    ("scene_detection", "scene_no_detection", True, "fallback_method"),
    ("scene_detection", "scene_threshold", True, "parameter_adjust"),
    ("scene_detection", "scene_too_short", True, "fallback_method"),
    ("scene_detection", None, False, "skip_video"),
    ("gpu_processing", "gpu_memory", True, "retry"),
    ("gpu_processing", "gpu_model_loading", True, "retry"),
    ("gpu_processing", None, False, "graceful_degrade"),
    ("scene_splitting", "disk", False, "abort_batch"),
    ("scene_splitting", None, True, "graceful_degrade"),
    ("knowledge_generation", None, True, "graceful_degrade"),
    ("other", "memory", True, "retry"),
    ("other", None, False, "skip_video"),
)

# Which keyword ladder reads the message at each stage (fixed values).
STAGE_LADDER = {
    "ffmpeg_extraction": ERROR_LADDERS["ffmpeg"],
    "scene_detection": ERROR_LADDERS["scene"],
    "gpu_processing": ERROR_LADDERS["gpu"],
    "scene_splitting": (("disk", ("disk", "space")),),
    "knowledge_generation": (),
    "other": (("memory", ("memory", "oom")),),
}


def recovery_action(stage="stage", message="message", attempts="attempts", tripped="tripped",
                    max_attempts: int = 3) -> Column:
    """struct(success, action) decided for one failure.

    Too many attempts give up at once; a tripped breaker then aborts the batch, whatever was decided.
    """
    s, m = _col(stage), F.lower(_col(message))
    s = F.when(s == "cpu_processing", F.lit("gpu_processing")).when(s.isin(*STAGE_LADDER), s).otherwise(F.lit("other"))

    def outcome(success: bool, action: str) -> Column:
        return F.struct(F.lit(success).alias("success"), F.lit(action).alias("action"))

    kind = F.lit(None).cast("string")
    for name, steps in STAGE_LADDER.items():
        if steps:
            matched = first_match([(m.rlike("|".join(w)), F.lit(k)) for k, w in steps], F.lit(None).cast("string"))
            kind = F.when(s == name, matched).otherwise(kind)
    decided = [(_col(attempts) >= max_attempts, outcome(False, "skip_video"))]
    for row_stage, row_kind, success, action in RECOVERY:
        hit = (s == row_stage) if row_kind is None else (s == row_stage) & F.coalesce(kind == row_kind, F.lit(False))
        decided.append((hit, outcome(success, action)))
    decision = first_match(decided, outcome(False, "skip_video"))
    return F.when(_col(tripped), outcome(False, "abort_batch")).otherwise(decision)


def failure_status(tripped="tripped", total="total", failures="failures", streak="streak", threshold: int = 3) -> Column:
    rate = _col(failures) * 100.0 / F.greatest(_col(total), F.lit(1))
    return first_match([
        (~_col(tripped), F.lit("healthy")),
        (rate > 50, F.lit("critical")),
        (_col(streak) >= threshold, F.lit("pattern_failure")),
    ], F.lit("moderate"))
