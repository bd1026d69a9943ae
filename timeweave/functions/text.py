"""Text expressions shared by the operators. All are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters cut from both ends of a word before it is compared.
EDGE_MARKS = ".,!?;:"
# Marks that end a sentence.
SENTENCE_ENDS = (".", "?", "!", "。", "؟")


def tokens(text: Column) -> Column:
    """Tokens at Unicode white space; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def norm_word(word: Column) -> Column:
    """Lower case without marks at the ends."""
    return F.btrim(F.lower(word), F.lit(EDGE_MARKS))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two texts' sets of lower-cased tokens; 0 if both are empty."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(text))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def is_generic_title(title: Column) -> Column:
    """Null, blank, or no more than the word clip and a number."""
    t = F.coalesce(F.trim(title.cast("string")), F.lit(""))
    return (t == "") | t.rlike(r"(?i)^\s*clip\s*\d*\s*$") | t.rlike(r"(?i)^\s*clip\s*\d+\s*[:\-–]\s*$")


def real_title(title: Column, topic: Column, hook: Column, reason: Column, rank: Column) -> Column:
    """The title if it says something, else the first eight words of topic, hook or reason (at most 80
    characters, closing marks cut), else ``Moment #rank``."""

    def short(c: Column) -> Column:
        words = F.array_join(F.slice(tokens(c), 1, 8), " ")
        cut = F.substring(F.regexp_replace(words, r"[.!?]+$", ""), 1, 80)
        return F.when(cut != "", cut)

    fallback = F.concat(F.lit("Moment #"), F.coalesce(rank.cast("string"), F.lit("?")))
    derived = F.coalesce(short(topic), short(hook), short(reason), fallback)
    return F.when(is_generic_title(title), derived).otherwise(F.trim(title))


def clip_filename(rank: Column, title: Column) -> Column:
    """rankNN_<safe title of at most 50 characters>.mp4"""
    named = F.coalesce(title, F.concat(F.lit("clip_"), rank.cast("string")))
    safe = F.regexp_replace(named, r"(?U)[^\w\s-]", "")
    safe = F.substring(F.regexp_replace(safe, r"(?U)\s+", "_"), 1, 50)
    number = F.when(F.length(rank.cast("string")) < 2, F.lpad(rank.cast("string"), 2, "0")).otherwise(rank.cast("string"))
    return F.concat(F.lit("rank"), number, F.lit("_"), safe, F.lit(".mp4"))


def preview(text: Column, n: int) -> Column:
    """White space squeezed; at most n characters, the last one an ellipsis if any were cut."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))


def to_score(value: Column) -> Column:
    """Rounded half to even and held within 0 to 100; what is no number is 0."""
    number = value.try_cast("double")
    ok = F.when(F.isnan(number), F.lit(None)).otherwise(number)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(ok, 0).cast("int"), F.lit(0))))


def clip_score(emotion: Column, hook: Column, retention: Column, personality: Column) -> Column:
    """Weights 4, 3, 2, 1 over ten; 0 if all are 0."""
    return (emotion * 4 + hook * 3 + retention * 2 + personality).cast("double") / F.lit(10.0)


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter of two intervals; 0 if either is empty."""
    shorter = F.least(e1 - s1, e2 - s2)
    overlap = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    return F.when(shorter > 0, overlap / shorter).otherwise(F.lit(0.0))


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc from seconds, hundredths rounded half to even."""
    cs = F.bround(F.greatest(seconds, F.lit(0.0)) * 100, 0).cast("long")
    part = lambda x, w: F.lpad(x.cast("string"), w, "0")
    return F.concat(
        F.floor(cs / 360000).cast("string"), F.lit(":"), part(F.floor(cs / 6000) % 60, 2), F.lit(":"),
        part(F.floor(cs / 100) % 60, 2), F.lit("."), part(cs % 100, 2),
    )


def split_log(line: Column) -> tuple[Column, Column]:
    """Level and message of ``[LEVEL] message``, ANSI colours cut first; INFO where no level stands."""
    plain = F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")
    level = F.regexp_extract(plain, r"^\s*\[([A-Z]+)\]\s*(.*)$", 1)
    message = F.regexp_extract(plain, r"^\s*\[([A-Z]+)\]\s*(.*)$", 2)
    has = level != ""
    return F.when(has, level).otherwise(F.lit("INFO")), F.when(has, message).otherwise(F.trim(plain))


def frame_rate(text: Column) -> Column:
    """``num/den`` or a number as frames a second; 30 if it says nothing."""
    parts = F.split(text, "/")
    top, bottom = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    rate = F.when(F.size(parts) == 2, F.try_divide(top, bottom)).otherwise(top)
    return F.coalesce(F.when(rate > 0, rate), F.lit(30.0))


def signature(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts as JSON."""
    named = F.struct(*(p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)))
    return F.substring(F.sha1(F.to_json(named, {"ignoreNullFields": "false"})), 1, 12)


def optional_float(text: Column) -> Column:
    """A number, or null where the text is null, empty or no number."""
    return F.when(text != "", text).try_cast("double")
