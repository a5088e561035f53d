"""Peak lists as text, token estimates and forbidden terms, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, decimals: int) -> Column:
    """A number with fixed decimals, rounded half to even on its binary value as Python does."""
    if decimals == 0:
        return F.rint(v).cast("bigint").cast("string")
    return F.call_function("format_number", v, F.lit("0." + "0" * decimals))


def rounded(v: Column, decimals: int = 4) -> Column:
    """A rounded number; NaN, infinite or null gives null."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.round(v, decimals))


def peaks_text(peaks: Column, cfg: dict) -> Column:
    """Serialise an array of (position, intensity, width): ascending positions, intensity clipped at 0 only, width absolute."""
    s = cfg["serialise"]
    ordered = F.array_sort(peaks, lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0))

    def one(p: Column) -> Column:
        fields = fixed(p["position"], s["pos_decimals"]), fixed(F.greatest(p["intensity"], F.lit(0.0)), s["int_decimals"]), fixed(F.abs(p["width"]), s["width_decimals"])
        return F.concat_ws(s["field_sep"], *fields)

    return F.array_join(F.transform(ordered, one), s["peak_sep"])


def number_pattern(decimals: int) -> str:
    return r"[0-9]+" if decimals == 0 else rf"[0-9]+\.[0-9]{{{decimals}}}"


def grammar(cfg: dict) -> str:
    """Anchored pattern of the serialised form."""
    s = cfg["serialise"]
    quote = lambda x: re.sub(r"([|.*+?()\[\]{}^$\\])", r"\\\1", x)
    one = quote(s["field_sep"]).join(number_pattern(s[k]) for k in ("pos_decimals", "int_decimals", "width_decimals"))
    return f"^(?:{one})(?:{quote(s['peak_sep'])}{one})*$"


def matches_grammar(text: Column, cfg: dict) -> Column:
    return text.rlike(grammar(cfg))


def parse_peaks(text: Column, cfg: dict, strict: bool = True) -> Column:
    """Peaks of a serialised text; an empty text gives no peaks. Others raise, or with ``strict`` off are null."""
    s = cfg["serialise"]
    quote = re.escape(s["peak_sep"])

    def one(chunk: Column) -> Column:
        f = F.split(chunk, re.escape(s["field_sep"]))
        get = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
        return F.struct(get(1).alias("position"), get(2).alias("intensity"), get(3).alias("width"))

    empty = F.array().cast("array<struct<position:double,intensity:double,width:double>>")
    wrong = F.raise_error(F.concat(F.lit(f"text does not match schema {cfg['schema']}: "), F.substring(text, 1, 80))) if strict else F.lit(None)
    return F.when(text == "", empty).when(matches_grammar(text, cfg), F.transform(F.split(text, quote), one)).when(text.isNotNull(), wrong.cast(empty_type()))


def empty_type() -> str:
    return "array<struct<position:double,intensity:double,width:double>>"


def raster(peaks: Column, lo: float, hi: float, width: float = 10.0) -> Column:
    """Largest intensity in each bin, at least 0; bins open to the right, outliers in the first or last bin."""
    n = max(1, round((hi - lo) / width))
    at = lambda p: F.least(F.greatest(F.floor((p["position"] - lo) / width), F.lit(0)), F.lit(n - 1))
    binned = F.transform(peaks, lambda p: F.struct(at(p).alias("k"), p["intensity"].alias("v")))

    def bins(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.filter(z, lambda p: p["k"] == k), F.lit(0.0), lambda m, p: F.greatest(m, p["v"])))

    # an array of one binds the peaks, which else were made again for every bin
    return F.get(F.transform(F.array(binned), bins), F.lit(0))


TOKEN = r"\d|[A-Za-z]+|\s+|[^\sA-Za-z\d]"


def estimate_tokens(text: Column) -> Column:
    """Tokens of a digit-splitting tokenizer, on the safe side: a digit, a run of blanks or another sign is one, letters count by threes."""
    # Unicode classes: any digit, any blank
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U)({TOKEN})"), F.lit(1))
    size = lambda t: F.when(t.rlike("^[A-Za-z]"), F.ceil(F.length(t) / 3)).otherwise(F.lit(1)).cast("int")
    return F.aggregate(found, F.lit(0), lambda n, t: n + size(t))


def estimate_tokens_sql(text: str) -> str:
    found = f"regexp_extract_all(coalesce({text}, ''), '{TOKEN}')"
    return f"CAST(coalesce(list_sum(list_transform({found}, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN CAST(ceil(length(t) / 3.0) AS INTEGER) ELSE 1 END)), 0) AS INTEGER)"


def term_pattern(terms: list[str]) -> str:
    """Case-insensitive pattern of forbidden terms; those of letters only need a non-letter on both sides."""
    if not terms:
        return "(?!)"
    esc = lambda t: re.sub(r"([^A-Za-z0-9 ])", r"\\\1", t)
    plain = sorted((t for t in terms if re.fullmatch("[A-Za-z]+", t)), key=lambda t: (-len(t), t))
    other = sorted((t for t in terms if not re.fullmatch("[A-Za-z]+", t)), key=lambda t: (-len(t), t))
    parts = [f"(?<![A-Za-z])(?:{'|'.join(plain)})(?![A-Za-z])"] if plain else []
    return "(?i)" + "|".join(parts + [esc(t) for t in other])


def label_terms(names, least: int = 3) -> list[str]:
    """Distinct lower-case vocabulary of at least ``least`` letters, sorted."""
    return sorted({n.strip().lower() for n in names if n and len(n.strip()) >= least})


def keep_fields(text: Column, cfg: dict, fields: str = "all") -> Column:
    """Leave one (``position``) or two (``position+intensity``) of a peak's three numbers."""
    s = cfg["serialise"]
    keep = {"all": 3, "position+intensity": 2, "position": 1}[fields]
    chunks = F.transform(F.split(text, re.escape(s["peak_sep"])), lambda c: F.substring_index(c, s["field_sep"], keep))
    return text if keep == 3 else F.array_join(chunks, s["peak_sep"])


def prompt(text: Column, template: str) -> Column:
    """(prompt, first character of the payload, one past its last) of every text; the template needs exactly one ``{text}``."""
    if template.count("{text}") != 1:
        raise ValueError("a template needs exactly one {text}")
    head, tail = template.split("{text}")
    return F.struct(F.concat(F.lit(head), text, F.lit(tail)).alias("prompt"), F.lit(len(head)).alias("start"), (F.length(text) + len(head)).alias("stop"))


def truthy(v: Column) -> Column:
    """Whether a cell says yes, in any case and between any blanks."""
    bare = F.regexp_replace(F.lower(v.cast("string")), r"(?U)^\s+|\s+$", "")
    # fixed values: the accepted spellings
    return F.coalesce(bare.isin("true", "correct", "1", "yes", "y", "right", "t", "✓", "✅"), F.lit(False))


def bare_name(v: Column) -> Column:
    """Lower-case name without a leading ``l-``."""
    return F.regexp_replace(F.lower(F.trim(v)), "^l-", "")


def pretty(label: Column, prefix: str = "fg_") -> Column:
    return F.replace(F.replace(label, F.lit(prefix), F.lit("")), F.lit("_"), F.lit(" "))


def interval_text(value: Column, lo: Column, hi: Column, p: Column | None = None) -> Column:
    """``0.981 [0.91, 1.00], p=0.032``; a missing value is ``n/a``."""
    body = F.concat(F.format_string("%.3f", value), F.when(lo.isNotNull() & hi.isNotNull(), F.format_string(" [%.2f, %.2f]", lo, hi)).otherwise(""))
    if p is not None:
        body = F.concat(body, F.when(p.isNotNull(), F.format_string(", p=%.3f", p)).otherwise(""))
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(body)


def combo_tag(feature: Column, model: Column) -> Column:
    return F.format_string("(%s/%s)", feature, model)


def tagged_text(fields: dict[str, Column]) -> Column:
    """``name: value`` parts joined by semicolons; missing or empty is NA."""
    return F.concat_ws("; ", *(F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("NA"))) for k, v in fields.items()))
