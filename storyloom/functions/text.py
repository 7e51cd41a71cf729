"""Scalar text functions as columns. Character classes follow Unicode; ``strip`` also removes U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequences left by UTF-8 read as Windows-1252, with what was meant, in the order of replacement.
MOJIBAKE = (
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\x9d", '"'),
    ("â€?", '"'),
    ("â€”", "—"),
    ("â€“", "–"),
    ("â€¦", "…"),
)

#: Tags whose blocks are no answer, those that may stay open, and the form of a code fence.
THINKING, UNCLOSED = ("think", "thinking", "reflection", "reasoning"), ("think", "thinking")
FENCED = r"(?s)```(?:json)?\s*(.*?)```"

NARRATOR = "NARRATOR"
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
GAP = r"(?U)[\s\x1c-\x1f]+"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def resolved_speaker(speaker: Column, kind: Column | None = None) -> Column:
    """The speaker, or else the type, or else ''; empty counts as absent."""
    return F.coalesce(non_empty(speaker), *([non_empty(kind)] if kind is not None else []), F.lit(""))


def is_structural(c: Column) -> Column:
    """Empty, or shorter than 80 without final punctuation: titles, breaks and the like."""
    s = strip(text_of(c))
    return (s == "") | ((F.length(s) < 80) & ~F.right(s, F.lit(1)).isin(".", "!", "?"))


def is_section_break(c: Column) -> Column:
    """Begins with the word chapter, or is short ASCII without lower-case letters; so are empty and digit-only texts."""
    s = strip(text_of(c))
    return s.rlike(r"(?i)^chapter\b") | ((s == F.upper(s)) & (F.length(s) < 80) & s.rlike(r"^[\x00-\x7F]*$"))


def file_stem(c: Column) -> Column:
    """Every character outside letters, digits, _ and - becomes _, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[^\w\-]", "_"))


def project_name(c: Column) -> Column:
    """Characters outside letters, digits, _, - and spaces go; gaps become one _; lower case."""
    return F.lower(F.regexp_replace(strip(F.regexp_replace(c, r"(?U)[^\w\- ]", "")), GAP, "_"))


def normalised(c: Column) -> Column:
    """Lower case without punctuation, words apart by one space."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text_of(c)), r"(?U)[^\w\s]", ""), GAP, " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(normalised(c), " "), lambda w: w != "")).cast("long")


def without_mojibake(c: Column) -> Column:
    for seen, meant in MOJIBAKE:
        c = F.replace(c, F.lit(seen), F.lit(meant))
    return c


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(c), r"\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def preview(c: Column, size: int = 60, label: Column | None = None) -> Column:
    """The first ``size`` characters, with ... if there are more, after an optional [label]."""
    short = F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)
    return short if label is None else F.when(text_of(label) != "", F.concat(F.lit("["), label, F.lit("] "), short)).otherwise(short)


def joined_style(first: Column, second: Column, sep: str) -> Column:
    """Both stripped parts that are not empty, apart by ``sep``; '' if there is none."""
    return F.concat_ws(sep, non_empty(strip(text_of(first))), non_empty(strip(text_of(second))))


def resolved_path(root: str, path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places; values are not searched for places themselves."""
    parts, rest = [], template
    while rest:
        spots = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, key = min(spots)
        parts += [F.lit(rest[:at]), text_of(values[key])]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def chat_turn(c: Column) -> Column:
    return F.concat(F.lit("<|im_start|>user\n"), c, F.lit("<|im_end|>\n"))


def without_thinking(c: Column) -> Column:
    """Closed think, thinking, reflection and reasoning blocks go, then what follows an unclosed think or thinking."""
    for tag in THINKING:
        c = F.regexp_replace(c, f"(?s)<{tag}>.*?</{tag}>", "")
    for tag in UNCLOSED:
        c = F.regexp_replace(c, f"(?s)<{tag}>.*", "")
    return c


def unfenced(c: Column) -> Column:
    """Contents of the first closed code fence, stripped; a text without one stays."""
    return F.when(c.rlike(FENCED), strip(F.regexp_extract(c, FENCED, 1))).otherwise(c)


def json_string(c: Column) -> Column:
    """A text as a JSON string, non-ASCII as it is; null for null."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def entry_json(speaker: Column, text: Column, instruct: Column) -> Column:
    """An entry as one line of JSON with blanks after colons and commas."""
    return F.concat(F.lit('{"speaker": '), json_string(speaker), F.lit(', "text": '), json_string(text), F.lit(', "instruct": '), json_string(instruct), F.lit("}"))


def pretty_entries(entries: Column) -> Column:
    """An array of entries as JSON, indented by two."""
    one = lambda e: F.concat(
        F.lit('  {\n    "speaker": '), json_string(e["speaker"]), F.lit(',\n    "text": '), json_string(e["text"]), F.lit(',\n    "instruct": '), json_string(e["instruct"]), F.lit("\n  }")
    )
    body = F.concat(F.lit("[\n"), F.array_join(F.transform(entries, one), ",\n"), F.lit("\n]"))
    return F.when(F.size(entries) > 0, body).otherwise(F.lit("[]"))


def stamped(name: Column, seconds: Column) -> Column:
    """An id made of a name and a time, which the caller gives, so that a job that is run again makes the same ids."""
    return F.concat(project_name(name), F.lit("_"), seconds.cast("long").cast("string"))


def stem_of(name: Column, *endings: str) -> Column:
    """A file name without the first of these endings that it has, or else without its last one."""
    out = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    for end in reversed(endings):
        out = F.when(F.endswith(name, F.lit(end)), F.substring(name, F.lit(1), F.length(name) - len(end))).otherwise(out)
    return out
