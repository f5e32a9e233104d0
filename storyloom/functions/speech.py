"""Labels, languages and scores of speech and sound, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chance_of_log, language_code

# The names under which recognisers know languages.
ALIGNER_LANGUAGES = {
    "zh": "Chinese", "yue": "Cantonese", "en": "English", "de": "German", "es": "Spanish", "fr": "French", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ko": "Korean", "ja": "Japanese",
}
RECOGNIZER_LANGUAGES = {
    "ja": "日文", "en": "英文", "zh": "中文", "ko": "韩文", "vi": "越南语", "th": "泰语", "id": "印尼语", "ms": "马来语", "fil": "菲律宾语", "ar": "阿拉伯语", "hi": "印地语", "bg": "保加利亚语", "hr": "克罗地亚语", "cs": "捷克语", "da": "丹麦语", "nl": "荷兰语", "et": "爱沙尼亚语", "fi": "芬兰语", "el": "希腊语", "hu": "匈牙利语", "ga": "爱尔兰语", "lv": "拉脱维亚语", "lt": "立陶宛语", "mt": "马耳他语", "pl": "波兰语", "pt": "葡萄牙语", "ro": "罗马尼亚语", "sk": "斯洛伐克语", "sl": "斯洛文尼亚语", "sv": "瑞典语", "yue": "粤语",
}
# Sound labels under other names.
SOUND_LABELS = {
    "crying": "crying_or_sobbing", "joyful exclamation": "joyful_exclamation", "gasp or alarm": "gasp_or_alarm", "scream or shout": "scream_or_shout", "heavy breathing": "heavy_breathing", "nonverbal vocalization": "nonverbal_vocalization", "water": "water", "crowd noise": "crowd", "instrumental music": "music", "vehicle or engine": "vehicle_or_engine", "quiet room tone": "room_tone", "impact or noise": "impact_or_noise",
}
SILENCE = "silence"


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def aligner_language(name: Column) -> Column:
    return F.coalesce(lookup(language_code(name), ALIGNER_LANGUAGES), F.lit("English"))


def recognizer_language(name: Column) -> Column:
    code = language_code(name)
    return F.coalesce(lookup(code, RECOGNIZER_LANGUAGES), code, F.lit("auto"))


def sound_label(label: Column) -> Column:
    return F.coalesce(lookup(label, SOUND_LABELS), label)


def level_db(samples: Column, floor: float = 1e-10) -> Column:
    """Root mean square in decibels; null for silence below ``floor`` and for no samples."""
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.nullif(F.size(samples), F.lit(0)))
    return F.when(rms >= floor, 20 * F.log10(rms))


def level_db_floored(samples: Column) -> Column:
    """Root mean square in decibels with a floor of -180."""
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.nullif(F.size(samples), F.lit(0)))
    return 20 * F.log10(rms + 1e-9)


def seconds_of(samples: Column, rate: int = 16_000) -> Column:
    return F.round(samples / rate, 3)


def mixed(a: Column, b: Column) -> Column:
    """Two signals added sample by sample, the shorter one padded, within -1 and 1."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))))


def mean_of(values: Column) -> Column:
    """The mean of an array; null if it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def volume_class(db: Column) -> Column:
    return F.when(db < -38, "quiet").when(db > -20, "loud").when(db.isNotNull(), "normal")


def rate_class(onsets: Column, seconds: Column) -> Column:
    """Onsets a second, for spans of 0.3 seconds or more."""
    rate = onsets / seconds
    return F.when(seconds >= 0.3, F.when(rate < 2, "slow").when(rate > 4, "fast").otherwise("normal"))


def pitch_class(voiced: Column) -> Column:
    """The trend of four or more voiced pitches: variable, rising, falling or steady."""
    n, mean = F.size(voiced), mean_of(voiced)
    spread = F.sqrt(mean_of(F.transform(voiced, lambda x: (x - mean) * (x - mean)))) / mean
    middle = (n - 1) / 2
    slope = F.aggregate(F.transform(voiced, lambda x, k: (k - middle) * x), F.lit(0.0), lambda a, x: a + x) / (n * (n * n - 1) / 12) / mean
    return F.when(n >= 4, F.when(spread > 0.25, "variable").when(slope > 0.003, "rising").when(slope < -0.003, "falling").otherwise("steady"))


def energy_class(rms: Column) -> Column:
    return F.when(rms < 0.02, "low").when(rms > 0.05, "high").when(rms.isNotNull(), "medium")


def insert_song(vocal_rms: Column, music_rms: Column) -> Column:
    """insert_song where vocals have over 0.3 of the music's level, else bgm."""
    return F.when((music_rms > 0) & (vocal_rms / music_rms > 0.3), "insert_song").otherwise("bgm")


def top_label(scores: Column, least: float, margin: float, silence_margin: float = 0.03) -> Column:
    """The label of an array of (label, sim) if it is sure: sim of ``least``, ``margin`` before the second, and not silence or close to it. Ties: the first."""
    ranked = F.reverse(F.array_sort(F.transform(scores, lambda s, k: F.struct(s["sim"].alias("sim"), (-k).alias("k"), s["label"].alias("label")))))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    quiet = F.array_max(F.transform(F.filter(scores, lambda s: s["label"] == SILENCE), lambda s: s["sim"]))
    sure = (first["sim"] >= least) & (F.coalesce(first["sim"] - second["sim"], F.lit(float("inf"))) >= margin) & (first["label"] != SILENCE) & F.coalesce(quiet + silence_margin < first["sim"], F.lit(True))
    return F.when(sure, sound_label(first["label"]))


def top_two(values: Column) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, 2)


def emotion(scores: Column) -> Column:
    """The label of the greatest score in an array of (label, score), without what stands before its last slash; ties: the first."""
    return emotion_of(scores)["label"]


def emotion_of(scores: Column, before: Column | None = None) -> Column:
    """(label, confidence): the same with its score, or the confidence that an entry had before if that is greater; no scores: null."""
    best = F.array_max(F.transform(scores, lambda s, k: F.struct(s["score"].alias("score"), (-k).alias("k"), s["label"].alias("label"))))
    confidence = best["score"].cast("double") if before is None else F.greatest(before.cast("double"), best["score"].cast("double"))
    return F.when(best.isNotNull(), F.struct(F.element_at(F.split(best["label"], "/"), -1).alias("label"), confidence.alias("confidence")))


def entry_confidence(*scores: Column, log_chance: Column | None = None) -> Column:
    """The first score that is given, else the chance of a mean log chance."""
    return F.coalesce(*scores, *([chance_of_log(log_chance)] if log_chance is not None else []))


def sample_range(start: Column, end: Column, rate: int) -> tuple[Column, Column]:
    """The first sample and the one after the last, both rounded down."""
    return (start * rate).cast("long"), (end * rate).cast("long")


def frame_times(start: Column, end: Column, n: Column) -> Column:
    """n points in time that divide a span into equal parts, its ends left out."""
    return F.transform(F.sequence(F.lit(1), n), lambda k: start + k * (end - start) / (n + 1))
