"""Text of clocks, event lines, prompts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock(t: Column | str = "t") -> Column:
    """[MM:SS.ss]; minutes may exceed 99."""
    t = _col(t)
    minutes = F.floor(t / 60).cast("bigint")
    return F.format_string("[%02d:%05.2f]", minutes, t - minutes * 60.0)


def _detail(details: Column, name: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(details, F.lit(name)), F.lit(default))


def _whole(details: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(details, F.lit(name)).try_cast("double"), F.lit(0.0)).cast("bigint").cast("string")


def event_line(t="t", description="description", source="source", details="details",
               with_speaker: bool = True, captions: bool = True) -> Column:
    """One line of the document for one event; null for events that are not shown."""
    d, s, m = _col(description), _col(source), _col(details)
    at = clock(t)
    word = F.concat(F.lit("["), _detail(m, "speaker", "UNKNOWN"), F.lit("] ")) if with_speaker else F.lit("")
    tagged = F.concat(at, F.lit(" - ("), s, F.lit(") "))

    def change(name, before, after, missing_before, missing_after):
        return F.concat(tagged, F.lit(f"{name}: "), _detail(m, before, missing_before), F.lit(" -> "),
                        _detail(m, after, missing_after))

    line = F.when(d == "Speaker Change", F.lit(None).cast("string"))
    line = line.when(d == "Word", F.concat(at, F.lit(" - "), word, _detail(m, "word", "")))
    if captions:
        line = line.when(s == "internvl3", F.concat(at, F.lit(" - [VLM] "), d))
    line = line.when(d == "Emotion Change", change("Emotion Change", "previous_emotion", "emotion", "unknown", "unknown"))
    line = line.when(d == "Musical Onset",
                     F.concat(tagged, F.lit("Musical Onset: "), _detail(m, "onset_character", "N/A")))
    line = line.when(d == "Harmonic Shift", change("Harmonic Shift", "previous_key", "new_key", "?", "?"))
    line = line.when(d == "Tempo Change", F.concat(
        tagged, F.lit("Tempo Change: "), _whole(m, "previous_tempo"), F.lit(" BPM -> "), _whole(m, "new_tempo"),
        F.lit(" BPM")))
    return line.otherwise(F.concat(tagged, d))


# The prompt is a fixed text around the time and the audio context.
PROMPT_HEAD = "<image>\nAnalyze this video frame at timestamp "
PROMPT_MIDDLE = "s.\n\nAudio context (full timeline):\n"
PROMPT_TAIL = (
    "\n\nDescribe what you see in a single flowing paragraph. Include the people, their positioning, clothing, "
    "the setting, lighting, objects, and any visible text or branding. Write as one comprehensive paragraph "
    "without bullet points or sections."
)


def prompt(t: Column | str, context: Column | str, plain: str, without: Column | None = None) -> Column:
    """Prompt for the frame at `t`; `plain` where there is no context.

    `without` says where that is: by default where the context is null or empty. Elsewhere a prompt with a missing part is null.
    """
    c, t = _col(context), _col(t)
    at = F.when(t.isNotNull(), F.format_string("%.2f", t))
    full = F.concat(F.lit(PROMPT_HEAD), at, F.lit(PROMPT_MIDDLE), c, F.lit(PROMPT_TAIL))
    return F.when(c.isNull() | (c == "") if without is None else without, F.lit(plain)).otherwise(full)


# What counts as a blank at the ends of a text: all space separators of Unicode.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def collapse(text: Column | str) -> Column:
    """Runs of ASCII white space (but for the vertical tab) become one blank; no space of any kind is left at the ends."""
    return F.btrim(F.regexp_replace(_col(text), r"[ \t\n\f\r]+", " "), F.lit(BLANKS))


def word_count(text: Column | str) -> Column:
    flat = collapse(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def snake(text: Column | str) -> Column:
    # Letter by letter: the two letters whose lower case would be two letters, or depend on their place, go first.
    return F.lower(F.translate(_col(text), " \u0130\u03a3", "_i\u03c3"))


def stem(path: Column | str) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def safe_name(name: Column | str) -> Column:
    return F.translate(_col(name), "/:\\", "___")


def parse_time(text: Column | str) -> Column:
    return F.to_timestamp(_col(text))


def age_hours(at: Column | str, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(_col(at))) / F.lit(3_600_000_000.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two equally long vectors, in double precision."""
    a, b = _col(a), _col(b)
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
