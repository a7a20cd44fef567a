"""Names, labels and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tags that describe a file and not its scene
TECHNICAL_TAGS = ("high_resolution", "low_resolution", "png_format", "jpeg_format", "webp_format")
# fixed values: spans of years, dates, calendar words before a chapter's name, names of screenshots
YEAR = r"((?:19|20)\d{2})"
SPAN = YEAR + r"\s*(?:-|~|至|到)\s*" + YEAR
DATE = YEAR + r"\s*(?:年|[-/.])\s*(\d{1,2})\s*(?:月|[-/.])\s*(\d{1,2})"
CALENDAR = r"^\s*(?:(?:\d{4}年)?\d{1,2}月\d{1,2}(?:日|号|[-—至到]\d{1,2}日)|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4}年\d{1,2}月|\d{4}年)\s*(?:[·:：,，\-—|]\s*)*"
SCREENSHOT = r"(?i)(?:screenshot|screen[ _-]?shot|snipaste|snipping[ _-]?tool|屏幕截图|屏幕快照|截图|截屏|スクリーンショット)"


def slugify(name: Column, fallback: str = "project") -> Column:
    """Lower-case letters and digits, joined by single hyphens."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def safe_name(name: Column, fallback: str = "album", most: int = 40) -> Column:
    """A file name: characters that file systems refuse and spaces become _, outer . and _ go, then it is cut."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r'[<>:"/\\|?*]', "_"), " ", "_")
    clean = F.substring(F.regexp_replace(clean, "^[._]+|[._]+$", ""), 1, most)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def chapter_name(name: Column, fallback: Column) -> Column:
    """A name without a leading date and outer punctuation; the fallback where nothing is left."""
    left = F.regexp_replace(F.regexp_replace(F.trim(name), CALENDAR, ""), "^[ ·:：,，—|-]+|[ ·:：,，—|-]+$", "")
    return F.coalesce(F.nullif(left, F.lit("")), F.nullif(F.trim(fallback), F.lit("")), F.lit("未命名章节"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_text(text: Column, most: int) -> Column:
    """The first characters of a text, escaped; empty for null."""
    return escape_html(F.substring(F.coalesce(F.trim(text), F.lit("")), 1, most))


def years(text: Column) -> Column:
    """Years named in a text, then those of spans of at most 20 years; each once, in order."""
    text = F.coalesce(text, F.lit(""))
    number = lambda found: F.transform(found, lambda y: y.cast("int"))
    ends = [number(F.regexp_extract_all(text, F.lit(SPAN), F.lit(i))) for i in (1, 2)]
    low, high = F.zip_with(*ends, lambda a, b: F.least(a, b)), F.zip_with(*ends, lambda a, b: F.greatest(a, b))
    spans = F.zip_with(low, high, lambda a, b: F.when(b - a <= 20, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(number(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))), F.flatten(spans)))


def dates(text: Column) -> Column:
    """Dates named in a text as ISO strings, ascending."""
    y, m, d = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DATE), F.lit(i)) for i in (1, 2, 3))
    months = F.zip_with(y, m, lambda a, b: F.concat(a, F.lit("-"), F.lpad(b, 2, "0")))
    return F.array_sort(F.zip_with(months, d, lambda a, b: F.concat(a, F.lit("-"), F.lpad(b, 2, "0"))))


def scene_tags(tags: Column) -> Column:
    """Trimmed lower-case tags without technical ones, distinct."""
    clean = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.array_distinct(F.filter(clean, lambda t: (t != "") & ~t.isin(*TECHNICAL_TAGS)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tags; null if either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def rewrite_attribute(html: Column, tag: str, attribute: str, old: Column, new: Column) -> Column:
    """html with tag's attribute values that equal old replaced by new."""
    quoted = F.regexp_replace(old, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_replace(html, F.concat(F.lit(rf'(<{tag}\b[^>]*\b{attribute}=")'), quoted, F.lit('(")')), F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1"), F.lit("$2")))


def screenshot(filename: Column) -> Column:
    """Whether a file name is a screenshot's."""
    return F.coalesce(filename.rlike(SCREENSHOT), F.lit(False))


def cjk_title(text: Column, most: int = 8, least: int = 2) -> Column:
    """The first Chinese characters of a text, nothing else; null if they are too few."""
    only = F.substring(F.regexp_replace(text, "[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]", ""), 1, most)
    return F.when(F.length(only) >= least, only)


def snippet(html: Column, most: int = 800) -> Column:
    """The first characters of a page's markup; empty for null."""
    return F.substring(F.coalesce(html, F.lit("")), 1, most)


def iso(time: Column) -> Column:
    """ISO 8601 of a time; null stays null."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
