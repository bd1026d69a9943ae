"""Turning raw model replies into rows: strict parsing in the JVM, salvage for what fails only."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is asked for, try by try, when a reply could not be read; further tries get the last.
RETRY_SUFFIXES = (
    "Return ONLY a valid JSON array, with no other text.",
    "The reply could not be read. Send the JSON array again: it starts with [ and ends with ], without fences, notes or thoughts.",
)
ITEMS = "array<map<string,string>>"


def cleaned(raw: Column) -> Column:
    """Without think blocks, code fences and leading safety lines."""
    strip = lambda c: F.btrim(c, F.lit(" \t\r\n\f\x0b"))
    out = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    out = strip(F.regexp_replace(strip(F.regexp_replace(out, r"```(?:json)?", "")), r"`+$", ""))
    safety = r"(?i)^(?:[ \t]*(?:(?:user|response|prompt)?[ \t]*safety[ \t]*:[ \t]*\S|safety[ \t]+categories[ \t]*:[ \t]*\S)[^\n]*(?:\n|$))+"
    return strip(F.regexp_replace(out, safety, ""))


def _objects(text: str) -> list[str] | None:
    """Objects of a JSON array as texts; of an object, those of its first array. None if it is neither."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), None)
    return [json.dumps(x, ensure_ascii=False) for x in data if isinstance(x, dict)] if isinstance(data, list) else None


def balanced_array(text: str) -> str | None:
    """The first bracketed part whose brackets close; brackets in strings do not count."""
    begin = text.find("[")
    depth, quoted, skip = 0, False, False
    for i in range(begin, len(text)) if begin >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                return text[begin : i + 1]
    return None


def leading_objects(text: str) -> list[str]:
    """The whole objects at the head of an array that breaks off."""
    out: list[str] = []
    if not text.startswith("["):
        return out
    decoder, at = json.JSONDecoder(), 1
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "]":
            return out
        try:
            item, at = decoder.raw_decode(text, at)
        except ValueError:
            return out
        if isinstance(item, dict):
            out.append(json.dumps(item, ensure_ascii=False))


def salvage(text: str | None) -> tuple[str, list[str]]:
    """Status (ok, balanced, partial, failed) and object texts of a cleaned reply."""
    if not text:
        return "failed", []
    whole = _objects(text)
    if whole is not None:
        return "ok", whole
    block = balanced_array(text)
    inner = _objects(block) if block else None
    if inner is not None:
        return "balanced", inner
    part = leading_objects(text)
    return ("partial", part) if part else ("failed", [])


def _strict(replies: DataFrame) -> DataFrame:
    """``replies`` with _items: the objects, each as JSON text, of a ``_text`` that is nothing but an array of
    them; else null. The array is a column of its own before it is looked at, so that it is read once."""
    text, read = F.col("_text"), F.col("_array")
    own = replies.withColumn("_array", F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")))
    objects = read.isNotNull() & F.forall(read, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    return own.withColumn("_items", F.when(objects, read)).drop("_array")


def parse_responses(responses: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """``keys``, status and items (array of object texts) of each reply.

    A reply that is an array of objects is read by Spark; the texts of others pass a Python function that
    looks for the array in a wrapping object, for a balanced array in other text, then for the whole objects
    at the head of a broken array. A null reply has failed. Replies are read once.
    """

    @F.pandas_udf("status string, items array<string>")
    def salvaged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("ok", None) if t is None else salvage(t) for t in texts], columns=["status", "items"])

    clean = _strict(responses.select(*keys, cleaned(F.col(raw)).alias("_text")))
    # null stands for a reply that was read, so that its text stays in the JVM
    found = clean.withColumn("_found", salvaged(F.when(F.col("_items").isNull(), F.coalesce("_text", F.lit("")))))
    return found.select(*keys, F.col("_found.status").alias("status"), F.coalesce("_items", "_found.items").alias("items"))


def clip_items(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each object: ``keys``, item_ord and the fields of a clip as text; start and end as numbers."""
    fields = "start string, end string, title string, topic string, caption string, reason string, hook string, closing_line string, "
    fields += "comment_bait string, social_description string, score_emotion string, score_hook string, score_retention string, "
    fields += "score_personality string, clip_score string"
    rows = parsed.select(*keys, F.posexplode("items").alias("item_ord", "_item")).withColumn("_f", F.from_json("_item", fields))
    rows = rows.withColumn("extra", F.from_json("_item", "map<string,string>"))
    out = rows.select(*keys, "item_ord", "_f.*", "extra")
    return out.withColumns({"start": F.col("start").try_cast("double"), "end": F.col("end").try_cast("double")})


def retry_requests(parsed: DataFrame, responses: DataFrame, keys: list[str], raw: str = "raw", attempt: str | None = None) -> DataFrame:
    """Failed replies with a bracket in them, and the suffix to ask again with; the rest are refusals. The
    suffix grows stronger with the number of tries so far (column ``attempt`` of ``responses``, from 0)."""
    failed = parsed.where("status = 'failed'").select(*keys)
    broken = responses.join(failed, keys, "left_semi").where(F.col(raw).rlike(r"[\[{]"))
    tries = F.least(F.col(attempt), F.lit(len(RETRY_SUFFIXES) - 1)) if attempt else F.lit(0)
    return broken.select(*keys, F.get(F.array(*(F.lit(s) for s in RETRY_SUFFIXES)), tries).alias("suffix"))


def prefer_content(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Of replies parsed from two fields (column field: content or reasoning), the content if it parsed,
    else the reasoning if that did, else the content."""
    usable = F.when(F.col("status") != "failed", 0).otherwise(1)
    order = F.struct(usable, F.when(F.col("field") == "content", 0).otherwise(1))
    best = parsed.groupBy(*keys).agg(F.min_by(F.struct("field", "status", "items"), order).alias("_b"))
    return best.select(*keys, "_b.field", "_b.status", "_b.items")
