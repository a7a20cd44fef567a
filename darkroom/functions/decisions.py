"""Status and decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def included(decision: Column) -> Column:
    """Everything but what was removed; no decision is included."""
    return ~decision.eqNullSafe("remove")


def review_status(decision: Column, suggestion: Column) -> Column:
    return (
        F.when(decision == "remove", "removed").when(decision == "keep", "kept")
        .when(suggestion.isin("review", "remove"), "pending_review").when(suggestion == "keep", "included").otherwise("unanalyzed")
    )


def pending(decision: Column, suggestion: Column) -> Column:
    return decision.isNull() & F.coalesce(suggestion.isin("review", "remove"), F.lit(False))


def effective(user: Column, suggested: Column) -> Column:
    """The user's decision, or what was suggested."""
    return F.coalesce(F.nullif(user, F.lit("")), suggested)


def bucket(key: Column, salt: str, digits: int, buckets: int) -> Column:
    """A stable bucket from the first hexadecimal digits of a salted SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, digits), 16, 10).cast("long"), F.lit(buckets))


def in_rollout(key: Column, salt: str, percent: int) -> Column:
    return bucket(key, salt, 4, 100) < percent


def validation_fold(key: Column) -> Column:
    """One fifth of the albums."""
    return bucket(key, "", 8, 5) == 0


def orientation(width: Column, height: Column, at: float = 1.12) -> Column:
    """Of a picture on a page: unknown without both sides."""
    return F.when((width > 0) & (height > 0), F.when(width > height * at, "landscape").when(height > width * at, "portrait").otherwise("square")).otherwise("unknown")


def analysed_orientation(width: Column, height: Column, at: float = 1.1) -> Column:
    """Of a picture under analysis, by the ratio of its sides."""
    ratio = width / F.greatest(height, F.lit(1))
    return F.when(ratio > at, "landscape").when(ratio < 1 / at, "portrait").otherwise("square")


def severity(value: Column, warning: float, severe: float, low_is_worse: bool = True) -> Column:
    worse = (lambda t: value < t) if low_is_worse else (lambda t: value > t)
    return F.when(worse(severe), "severe").when(worse(warning), "warning").otherwise("ok")


def resume_step(status: Column) -> Column:
    """Where an album's work goes on."""
    return F.when(status == "uploaded", "cleaning").when(status == "cleaned", "chapters").when(status == "clustered", "planning").when(status.isin("planned", "rendered", "exported"), "export").otherwise("upload")


def workspace_phase(status: Column, analysed: Column, confirmed: Column, album: Column) -> Column:
    """From a profile's status, the revisions at which it was analysed and confirmed, and the album's revision."""
    return (
        F.when(status.isNull() | (~analysed.eqNullSafe(album) & (status != "confirmed")), "needs_analysis")
        .when(status == "candidates_ready", "choose_theme").when(status == "review_pending", "review_theme_photos")
        .when((status == "confirmed") & confirmed.eqNullSafe(album), "ready_to_cluster").otherwise("needs_analysis")
    )


def print_spec(size: Column, bleed: Column, margin: Column, dpi: Column, profile: Column, sizes: tuple[str, ...] = ("A4", "A5", "square")) -> Column:
    """Normalised settings within their limits, and a warning for each that could not be read. Null settings take defaults."""
    number = lambda c, t, default, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast(t), F.lit(default))))
    unread = lambda c, t, name: F.when(c.isNotNull() & c.try_cast(t).isNull(), name)
    size, colour = F.coalesce(F.nullif(size, F.lit("")), F.lit("A4")), F.lower(F.coalesce(F.nullif(profile, F.lit("")), F.lit("rgb")))
    known, supported = size.isin(*sizes), colour.isin("rgb", "cmyk")
    warnings = F.array_compact(F.array(F.when(~known, "book_size"), unread(bleed, "double", "bleed_mm"), unread(margin, "double", "safe_margin_mm"), unread(dpi, "int", "page_dpi"), F.when(~supported, "color_profile")))
    return F.struct(
        F.when(known, size).otherwise("A4").alias("book_size"), number(bleed, "double", 3.0, 0.0, 8.0).alias("bleed_mm"), number(margin, "double", 8.0, 4.0, 18.0).alias("safe_margin_mm"),
        number(dpi, "int", 300, 150, 600).alias("page_dpi"), F.when(supported, colour).otherwise("rgb").alias("color_profile"), warnings.alias("warnings"),
    )


def accessible(user: Column, admin: Column, owner: Column) -> Column:
    """Whether a user may see what an owner has: admins, the owner, and all where nobody owns it."""
    return F.coalesce(admin, F.lit(False)) | owner.isNull() | F.coalesce(user == owner, F.lit(False))


def chosen(decision: Column, wanted: str) -> Column:
    """Whether a photo is listed under a recommendation: keep (all that is not removed), remove, or any other word for all."""
    return F.lit(True) if wanted not in ("keep", "remove") else ~included(decision) if wanted == "remove" else included(decision)


def analysis_refusal(status: Column, pending: Column) -> Column:
    """Why an album's theme can't be analysed yet; null if it can."""
    return F.when(status.isin("draft", "uploaded"), "cleaning_not_completed").when(F.coalesce(pending, F.lit(0)) > 0, "cleaning_review_pending")


def analysis_key(album: Column, revision: Column, version: str, custom: Column) -> Column:
    """The key under which equal requests of an analysis are one; of the custom text the first 500 characters count."""
    text = F.coalesce(F.nullif(F.substring(F.trim(custom), 1, 500), F.lit("")), F.lit("default"))
    return F.concat_ws(":", F.lit("theme-analysis"), album, revision, F.lit(version), F.substring(F.sha2(text, 256), 1, 12))


def reopening(status: Column, chapters: Column, confirmed: Column) -> Column:
    """What reopening a theme review does: nothing where it is open, a refusal, or reopen, which removes chapters only if that was confirmed."""
    many = F.coalesce(chapters, F.lit(0)) > 0
    return (
        F.when(status == "review_pending", "open").when(~F.coalesce(status == "confirmed", F.lit(False)), "not_available")
        .when(many & ~F.coalesce(confirmed, F.lit(False)), "confirmation_needed").when(many, "reopen_and_clear").otherwise("reopen")
    )


# fixed values: providers that each stage may have
STAGE_PROVIDERS = {"chapter": ("openai_compatible",), "chapter_embedding": ("dashscope_multimodal_embedding",), "layout": ("openai_compatible",)}


def provider_allowed(stage: Column, provider: Column) -> Column:
    """Whether a stage may have a provider; unknown stages may have none."""
    out = F.lit(False)
    for name, allowed in STAGE_PROVIDERS.items():
        out = F.when(stage == name, F.coalesce(provider.isin(*allowed), F.lit(False))).otherwise(out)
    return out


def deletion_refusal(active: Column, albums: Column, force: Column) -> Column:
    """Why a project can't be deleted: tasks that run, or albums unless it is forced; null if it can."""
    some = lambda n: F.coalesce(n, F.lit(0)) > 0
    return F.when(some(active), "running_tasks").when(some(albums) & ~F.coalesce(force, F.lit(False)), "contains_albums")
