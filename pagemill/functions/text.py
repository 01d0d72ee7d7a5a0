"""Column functions on strings: names, paths, escaping, page ranges, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SUFFIXES = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "pdf"]
ILLEGAL_IN_NAMES = r'[<>:"/\\|?*\x00-\x1f]'
DEVICE_NAMES = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$)"
DEFAULT_NAME = "识别结果"
MOST_OF_RANGE, MOST_OF_NAME = 2000, 160
PROFILE_LABELS = {"fast": "轻量", "accurate": "高精度"}
MODE_LABELS = {"text": "文字", "table": "表格"}
MIXED_LABEL = "混合"
SENTENCE_END = "[。！？.!?][」』”’\"')）\\]]*$"
LIST_START = rf"^(?:[•●■◆・※]|[-*]{WHITE}|[0-9０-９]+(?:[.．](?![0-9０-９])|[)）、])|[（(][0-9]+[）)]|[一二三四五六七八九十]+[、．])"
DIALOGUE_START = "^[「『“]"
CJK = r"[\x{3000}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]"
HEADING = rf"(?i)^(?:第[一二三四五六七八九十百千〇零0-9]+[章节部篇]|Chapter{WHITE}+[0-9]+|序言$|目录$)"
# end of fixed values
WHITE_CLASS = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), WHITE)  # as Python writes it
WHITE_CHARS = "".join(chr(i) for i in range(0x3001) if re.match(WHITE_CLASS, chr(i)))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def escape_html(c: Column, quote: str = "&#39;") -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def base_name(path: Column) -> Column:
    last = F.regexp_extract(path, r"([^\\/]*)\z", 1)
    return F.when(last == "", path).otherwise(last)


def stem(name: Column) -> Column:
    """Without the last extension; a leading dot is no extension, nor is a dot at the end."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)\z", 1))


def admitted(path: Column) -> Column:
    return extension(path).isin(SUFFIXES)


def queue_key(path: Column) -> Column:
    """Paths with a drive letter are the same whatever their case."""
    return F.when(path.rlike(r"^[A-Za-z]:[\\/]"), F.lower(path)).otherwise(path)


def natural_key(c: Column, width: int = 20) -> Column:
    """Digit runs by value, letters whatever their case and accents: compare under UNICODE_CI_AI."""
    pieces = F.regexp_extract_all(c, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    padded = F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), width, "0")).otherwise(p))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def safe_name(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(c, ILLEGAL_IN_NAMES, "_"), r"^[ .]+|[ .]+\z", "")
    name = F.substring(name, 1, MOST_OF_NAME)
    name = F.when(name == "", F.lit(DEFAULT_NAME)).otherwise(name)
    return F.when(name.rlike(DEVICE_NAMES), F.concat(F.lit("_"), name)).otherwise(name)


def label(c: Column, labels: dict[str, str]) -> Column:
    out = F.lit(MIXED_LABEL)
    for k, v in labels.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def decorated_name(stem_: Column, profile: Column, mode: Column, prefix: str, suffix: str, date: Column) -> Column:
    name = F.concat(F.lit(prefix[:100]), stem_, F.lit(suffix[:100]))
    for token, value in (("{date}", date), ("{profile}", label(profile, PROFILE_LABELS)), ("{mode}", label(mode, MODE_LABELS))):
        name = F.replace(name, F.lit(token), value)
    return safe_name(name)


def page_range(value: Column, total: Column) -> Column:
    """Zero-based pages, ascending and distinct; all if empty; null if any token is invalid or there is no page."""
    text = F.replace(trimmed(value), F.lit("，"), F.lit(","))
    token = rf"{WHITE}*([0-9]{{1,9}}){WHITE}*(?:-{WHITE}*([0-9]{{1,9}}){WHITE}*)?"
    bounds = F.transform(
        F.split(text, ",", -1),
        lambda t: F.when(
            t.rlike(rf"^{token}\z"),
            F.struct(F.regexp_extract(t, token, 1).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(t, token, 2), F.lit("")), F.regexp_extract(t, token, 1)).cast("int").alias("b")),
        ),
    )
    valid = F.forall(bounds, lambda p: p.isNotNull() & (p["a"] >= 1) & (p["a"] <= p["b"]) & (p["b"] <= total))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(bounds, lambda p: F.sequence(p["a"] - 1, p["b"] - 1)))))
    return (
        F.when((total < 1) | value.isNull() | (F.length(value) > MOST_OF_RANGE), F.lit(None))
        .when(text == "", F.sequence(F.lit(0), total - 1))
        .when(F.coalesce(valid, F.lit(False)), pages)
    )


def resume_prefix(selected: Column, completed: Column) -> Column:
    """Pages still to do; null unless the completed ones are the first of the selection."""
    return F.when(F.slice(selected, F.lit(1), F.size(completed)) == completed, F.array_except(selected, completed))


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, halves rounded up; n: long, or decimal without a fraction, of which no digit is lost."""
    kib, mib, gib = (n.cast("double") / 1024**k for k in (1, 2, 3))
    cents = n.cast("decimal(38,0)") * 100 + 2**29
    large = ((cents - cents % 2**30) / 2**30 / 100).cast("decimal(38,2)")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(kib < 1024, F.format_string("%.1f KB", kib))
        .when(mib < 1024, F.format_string("%.1f MB", mib))
        .when(n < 2**53, F.format_string("%.2f GB", gib))
        .otherwise(F.concat(large.cast("string"), F.lit(" GB")))
    )


def cell_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two keys; 1 if both are empty, 0 if one is."""
    return (
        F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )


def margin_key(text: Column, box: Column, height: Column) -> Column:
    """Where a line stands in the page's top or bottom margin, and its text with numbers as #; empty elsewhere."""
    usable = (height > 0) & (F.size(box) == 4) & (F.length(text) <= 100)
    zone = F.when(box[3] < height * 0.09, "top").when(box[1] > height * 0.91, "bottom")
    number = trimmed(text).rlike(rf"^(?:{WHITE}|[0-9０-９ivxlcdmIVXLCDM—–\-·第页頁])+\z")
    key = F.when(number, F.lit("page-number")).otherwise(F.concat(zone, F.lit(":"), F.regexp_replace(trimmed(text), "[0-9０-９]+", "#")))
    return F.when(F.coalesce(usable & zone.isNotNull(), F.lit(False)), key).otherwise("")


def words_of(text: Column) -> Column:
    """Distinct lower-case ASCII words of four letters or more."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z]{4,}(?![A-Za-z0-9_])"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def upper_median(values: Column, fallback) -> Column:
    """The middle of the positive finite values, the upper one of two; ``fallback`` if there is none."""
    good = F.array_sort(F.filter(values, lambda v: (v > 0) & ~F.isnan(v) & (v < float("inf"))))
    middle = F.transform(F.array(good), lambda g: F.get(g, (F.size(g) / 2).cast("int")))[0]  # sorted once
    return F.coalesce(middle, fallback)
