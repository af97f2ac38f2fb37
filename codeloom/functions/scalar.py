"""Scalar column functions over node attributes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names in rank order.
SEVERITIES = ("none", "low", "medium", "high")
# Words that a search query drops.
STOP_WORDS = frozenset(
    (
        "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as "
        "into through during before after above below between under again further then once here there when where why how all both each few more most "
        "other some such no nor not only own same so than too very just because but and or if while that this it its my your our their he she they we "
        "you me him her us them"
    ).split()
)


def one_line(text: Column, most: int = 140) -> Column:
    """White space collapsed and trimmed; longer texts are clipped with an ellipsis. Empty and null give null."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    clipped = F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)
    return F.when(F.coalesce(flat, F.lit("")) != "", clipped)


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, as scores are shown."""
    return F.floor(x + 0.5)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 units, rounded up; null is 0."""
    units = F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2
    return F.ceil(units / 4)


def query_tokens(query: str) -> list[str]:
    """The first eight words of two characters or more that are no stop words."""
    import re

    return [w for w in re.split(r"[^0-9A-Za-z_/$]+", query.lower()) if len(w) >= 2 and w not in STOP_WORDS][:8]


def severity_rank(severity: Column) -> Column:
    """0 for none or missing, up to 3 for high."""
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        if i:
            out = F.when(severity == s, i).otherwise(out)
    return out


def directory(path: Column) -> Column:
    """The path without its last part; ``/`` at the top."""
    parts = F.split(path, "/")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit("")), F.lit("/"))


def lines(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def score_of(score: Column) -> Column:
    return F.coalesce(score.cast("double"), F.lit(0.0))


def compact(score: str = "score") -> list[Column]:
    """The narrow projection that list answers use. It never reads source code."""
    sev = F.col("severity")
    return [
        F.col("id"), F.col("name"), F.col("type"), F.col("file_path"), lines(F.col("start_line"), F.col("end_line")).alias("lines"),
        round_half_up(score_of(F.col(score))).cast("long").alias("score"), one_line(F.col("business_summary")).alias("summary"), F.when(severity_rank(sev) > 0, sev).alias("severity"),
    ]


def keyword_score(tokens: list[str]) -> Column:
    """3 for a token in the name, 2 in the path, 1 in the business summary."""
    total = F.lit(0)
    for t in tokens:
        for c, w in (("name", 3), ("file_path", 2), ("business_summary", 1)):
            total = total + F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)), w).otherwise(0)
    return total


def band(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def type_label(kind: Column) -> Column:
    """``STATE_STORE`` to ``State store``: only the first underscore is replaced."""
    rest = F.lower(F.substring(kind, 2, 1000))
    at = F.instr(rest, "_")
    return F.concat(F.substring(kind, 1, 1), F.when(at > 0, F.overlay(rest, F.lit(" "), at, F.lit(1))).otherwise(rest))


def strip_html(text: Column, most: int = 100) -> Column:
    return F.concat(F.rtrim(F.substring(F.regexp_replace(text, "<[^>]*>", ""), 1, most)), F.lit("…"))


def sanitize_html(text: Column) -> Column:
    """Tags outside the allow-list go, and so do the attributes of the rest (a keeps href when it is http, https or mailto)."""
    bad = F.regexp_replace(text, r"(?is)<(script|style|iframe|object|embed)\b.*?</\1\s*>", "")
    bad = F.regexp_replace(bad, r"(?i)<(?!/?(?:p|br|strong|em|code|pre|ul|ol|li|a|span)\b)[^>]*>", "")
    bad = F.regexp_replace(bad, r'(?i)<a\b[^>]*?\bhref\s*=\s*"((?:https?:|mailto:)[^"]*)"[^>]*>', '<a href="$1">')
    return F.regexp_replace(bad, r'(?i)<(p|br|strong|em|code|pre|ul|ol|li|span|a)\b(?! href="(?:https?:|mailto:))[^>]*>', "<$1>")


def clean_version(spec: Column) -> Column:
    return F.regexp_replace(spec, r"^[\^~]", "")


def mask_secret(key: Column) -> Column:
    return F.concat(F.lit("****"), F.right(key, F.lit(4)))


def node_language(path: Column, repo_language: str | None = None) -> Column:
    """The repository's language if it names one, else by file extension."""
    known = {"typescript": "typescript", "javascript": "javascript", "python": "python", "java": "java", "go": "go", "rust": "rust"}
    for k, v in known.items():
        if repo_language and k in repo_language.lower():
            return F.lit(v)
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit("typescript")
    for e, v in {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "java": "java", "go": "go", "rs": "rust"}.items():
        out = F.when(ext == e, v).otherwise(out)
    return out


def rendering_boundary(metadata: Column) -> Column:
    """From a JSON column; ``unset`` when it is missing."""
    return F.coalesce(F.get_json_object(metadata, "$.renderingBoundary"), F.lit("unset"))


def metadata_strings(metadata: Column, key: str) -> Column:
    """A list in a JSON column; anything that is no list gives an empty one."""
    raw = F.get_json_object(metadata, f"$.{key}")
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array().cast("array<string>"))


def metadata_string(metadata: Column, key: str) -> Column:
    """A string in a JSON column; missing and nested values give an empty one."""
    raw = F.get_json_object(metadata, f"$.{key}")
    return F.when(raw.startswith("[") | raw.startswith("{"), "").otherwise(F.coalesce(raw, F.lit("")))


def node_size(score: Column, low: Column, high: Column) -> Column:
    """Drawing size from a score and the least and greatest one."""
    return F.when(high == low, F.lit(60)).otherwise(F.greatest(F.lit(80), F.floor(40 + F.sqrt((score - low) / (high - low)) * 120 + 0.5)))


def route_match(method: Column, path: Column, routes: list[tuple[str, str]]) -> Column:
    """(pattern, params) of the first route (method, pattern) that fits, else null. A ``:name`` part takes any one part of the path."""
    parts, out = F.split(path, "/"), F.lit(None).cast("struct<pattern:string,params:map<string,string>>")
    for m, pattern in reversed(routes):
        want = pattern.split("/")
        fits = (method == m) & (F.size(parts) == len(want))
        for i, w in enumerate(want):
            if not w.startswith(":"):
                fits = fits & (F.get(parts, i) == w)
        named = [(w[1:], F.get(parts, i)) for i, w in enumerate(want) if w.startswith(":")]
        params = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in named]).cast("array<string>"), F.array(*[v for _, v in named]).cast("array<string>"))
        out = F.when(fits, F.struct(F.lit(pattern).alias("pattern"), params.alias("params"))).otherwise(out)
    return out


def json_row(*cols: Column) -> Column:
    """One JSON object of some columns; nulls are kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def success(data: Column) -> Column:
    """An answer that carries a JSON text."""
    return F.concat(F.lit('{"success":true,"data":'), F.coalesce(data, F.lit("null")), F.lit("}"))


def failure(message: Column, code: Column | None = None, tool: Column | None = None) -> Column:
    """An error with a code, ``INTERNAL`` if there is none, and a tool to use instead if there is one."""
    named = F.coalesce(code, F.lit("INTERNAL")) if code is not None else F.lit("INTERNAL")
    return F.to_json(F.struct(F.struct(named.alias("code"), message.alias("message"), (tool if tool is not None else F.lit(None).cast("string")).alias("suggestedTool")).alias("error")))
