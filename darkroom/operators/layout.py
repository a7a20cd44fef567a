"""Pages of an album: pagination, templates, and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions import decisions, texts
from darkroom.operators import graphs


def pages(photos: DataFrame, per_page: int = 3) -> DataFrame:
    """photos with page (from 1 through the album) and slot, in order of chapter and place; chapters begin pages.

    photos: album_id, chapter, place, photo_id, width, height."""
    size = max(1, min(4, per_page))
    inside = Window.partitionBy("album_id", "chapter").orderBy("place", "photo_id")
    rows = photos.withColumn("_n", F.row_number().over(inside) - 1).withColumns({"_chunk": F.floor(F.col("_n") / size), "slot": F.col("_n") % size})
    return rows.withColumn("page", F.dense_rank().over(Window.partitionBy("album_id").orderBy(F.asc_nulls_last("chapter"), "_chunk"))).drop("_n", "_chunk")


def templates(paged: DataFrame) -> DataFrame:
    """(album_id, page, photos, template): by the number of a page's photos and their orientation."""
    o = decisions.orientation(F.col("width"), F.col("height"))
    by = paged.groupBy("album_id", "page").agg(F.count("*").alias("photos"), F.count_if(o == "portrait").alias("p"), F.count_if(o == "landscape").alias("l"))
    n, p, wide = F.col("photos"), F.col("p"), F.col("l")
    key = (
        F.when(n <= 1, F.when(wide == 1, "cinema_landscape").when(p == 1, "gallery_portrait").otherwise("full_page"))
        .when(n == 2, F.when(p == 2, "half_half").when(wide >= 1, "two_column").otherwise("staggered_duo"))
        .when(n == 3, F.when(p >= 2, "one_large_two_small").when(wide >= 2, "triptych_strip").otherwise("grid_3"))
        .otherwise(F.when(p >= 3, "mosaic_mix").otherwise("grid_4"))
    )
    return by.select("album_id", "page", "photos", key.alias("template"))


def markup(paged: DataFrame, kinds: DataFrame, caption: str) -> DataFrame:
    """(album_id, page, html): one section for each page, its captions escaped and in order of slots."""
    figures = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.concat(F.lit("<figure>"), texts.html_text(F.col(caption), 120), F.lit("</figure>")).alias("h")))), lambda s: s["h"]), "")
    by = paged.groupBy("album_id", "page").agg(figures.alias("body"))
    return by.join(kinds, ["album_id", "page"]).select("album_id", "page", F.concat(F.lit('<section class="'), F.col("template"), F.lit('">'), F.col("body"), F.lit("</section>")).alias("html"))


def books(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(album_id, html): a document for each album, its sections in order. titles(album_id, title)."""
    body = sections.groupBy("album_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda s: s["html"]), "").alias("body"))
    head = F.concat(F.lit("<!doctype html><title>"), texts.html_text(F.col("title"), 80), F.lit("</title>"))
    return titles.join(body, "album_id", "left").select("album_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("html"))


def moved(current: DataFrame, moves: DataFrame) -> DataFrame:
    """(chapter, photo_id, place) after photos were moved to the ends of chapters in order; places are renumbered from 0.

    current(chapter, photo_id, place), moves(chapter, photo_id, nth). A photo that is in the chapter already stays where it is."""
    moves = moves.join(current.select("chapter", "photo_id"), ["chapter", "photo_id"], "left_anti")
    stay = current.join(moves.select("photo_id"), "photo_id", "left_anti").select("chapter", "photo_id", F.lit(0).alias("late"), F.col("place").alias("nth"))
    every = stay.unionByName(moves.select("chapter", "photo_id", F.lit(1).alias("late"), "nth"))
    return every.select("chapter", "photo_id", (F.row_number().over(Window.partitionBy("chapter").orderBy("late", "nth", "photo_id")) - 1).alias("place"))


# fixed values: pages in millimetres, and words of an instruction with the template that each asks for, the first that occurs
PAGE_MM = {"A4": (210, 297), "A5": (148, 210), "square_10inch": (200, 200)}
ASKED = (
    (("full", "全页"), "full_page"), (("half", "对半"), "half_half"), (("two", "双栏"), "two_column"), (("grid_3", "三图"), "grid_3"), (("grid_4", "四图"), "grid_4"), (("1big", "一大两小"), "one_large_two_small"),
)


def page_mm(size: Column) -> Column:
    """(width, height) of a book's pages in millimetres; A4 for unknown sizes."""
    pair = lambda mm: F.struct(F.lit(mm[0]).alias("width"), F.lit(mm[1]).alias("height"))
    out = pair(PAGE_MM["A4"])
    for name, mm in PAGE_MM.items():
        out = F.when(size == name, pair(mm)).otherwise(out)
    return out


def asked_template(instruction: Column, current: Column) -> Column:
    """The template that an instruction names, else the current one."""
    low, out = F.lower(instruction), F
    for (latin, other), template in ASKED:
        out = out.when(F.contains(low, F.lit(latin)) | F.contains(instruction, F.lit(other)), template)
    return out.otherwise(current)


def settled(proposals: DataFrame, most: int = 120) -> DataFrame:
    """proposals with `ordered` and `captions` that a page can use: an order that names all its photos once, else the photos' own, and a caption for each.

    proposals: photos array<long>, proposed array<long>, captions array<struct<photo_id,text>>. Of captions of one photo the first counts."""
    known = F.array_distinct(F.filter("proposed", lambda p: F.array_contains("photos", p)))
    ordered = F.when(F.size(known) == F.size("photos"), known).otherwise(F.col("photos"))
    said = lambda p: F.filter("captions", lambda c: c["photo_id"] == p)
    text = lambda p: F.coalesce(F.substring(F.trim(F.get(said(p), 0)["text"]), 1, most), F.lit(""))
    return proposals.withColumn("ordered", ordered).withColumn("captions", F.transform("ordered", lambda p: F.struct(p.alias("photo_id"), text(p).alias("text"))))


def full_books(sections: DataFrame, chapters: DataFrame, albums: DataFrame) -> DataFrame:
    """(album_id, html): a document for each album: a cover, for each chapter in order of its first page a divider and its pages, and a closing page.

    sections(album_id, chapter, page, html), chapters(album_id, chapter, name, description, photos), albums(album_id, title, cover_title, style,
    photo_count). Pages without a known chapter have no divider. Parts are counted first and joined as rows, so only one album's markup meets in one row."""
    first = sections.groupBy("album_id", "chapter").agg(F.min("page").alias("first"), F.count("*").alias("pages"))
    named = first.join(chapters, ["album_id", "chapter"]).withColumn("nth", F.row_number().over(Window.partitionBy("album_id").orderBy("first")))
    text = lambda c, most: texts.html_text(F.col(c), most)
    p = lambda kind, body: F.concat(F.lit(f'<p class="{kind}">'), body, F.lit("</p>"))
    page = lambda kind, *body: F.concat(F.lit(f'<section class="{kind}">'), *body, F.lit("</section>"))
    counts = lambda *pairs: p("counts", F.concat_ws(", ", *(F.concat(F.col(c).cast("string"), F.lit(f" {word}")) for c, word in pairs)))
    divider = page("divider", p("kicker", F.concat(F.lit("Chapter "), F.lpad(F.col("nth").cast("string"), 2, "0"))), F.lit("<h2>"), text("name", 80), F.lit("</h2>"), p("description", text("description", 180)), counts(("photos", "Photos"), ("pages", "Pages")))
    size = albums.select("album_id").join(chapters.groupBy("album_id").agg(F.count("*").alias("chapters")), "album_id", "left").join(sections.groupBy("album_id").agg(F.count("*").alias("pages")), "album_id", "left").na.fill(0)
    whole = albums.join(size, "album_id")
    title = F.coalesce(F.nullif(F.trim("cover_title"), F.lit("")), F.col("title"))
    subtitle = F.when(F.trim(title) != F.trim("title"), p("subtitle", text("title", 80))).otherwise("")
    cover = page("cover", F.lit("<h1>"), texts.html_text(title, 80), F.lit("</h1>"), subtitle, counts(("photo_count", "Photos"), ("chapters", "Chapters")), p("style", text("style", 40)))
    closer = page("closer", F.lit("<h2>"), text("title", 80), F.lit("</h2>"), counts(("photo_count", "Photos"), ("chapters", "Chapters"), ("pages", "Pages")))
    # places: cover, then of each page number the divider before the page, then the closing page
    part = lambda at, kind, html: F.struct(F.lit(at).cast("long").alias("page") if isinstance(at, int) else at.cast("long").alias("page"), F.lit(kind).alias("kind"), html.alias("html")).alias("part")
    rows = sections.select("album_id", part(F.col("page"), 1, F.col("html"))).unionByName(named.select("album_id", part(F.col("first"), 0, divider))).unionByName(whole.select("album_id", part(-1, 0, cover))).unionByName(whole.select("album_id", part(1 << 40, 2, closer)))
    body = rows.groupBy("album_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda s: s["html"]), "").alias("body"))
    return albums.join(body, "album_id").select("album_id", F.concat(F.lit("<!doctype html><title>"), text("title", 80), F.lit("</title>"), F.col("body")).alias("html"))


def shown(rows: DataFrame, keys: list[str], order: list[F.Column], page: int = 24, clicks: int = 0) -> DataFrame:
    """Of each list the first page of rows, and one more for each click."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= page * (clicks + 1)).drop("_n")


def merged(current: DataFrame, merges: DataFrame) -> DataFrame:
    """(chapter, photo_id, place) after chapters were merged into others: their photos follow the target's in order of chapter and place, each photo once.

    current(chapter, photo_id, place), merges(source, target); a chapter merged into itself stays. A target that was merged itself passes all on, along chains of any
    length; of chapters that were merged in a circle the smallest takes all."""
    into = graphs.followed(merges, []).select(F.col("node").alias("source"), F.col("end").alias("target")).where("source <> target")
    rows = current.join(into, current["chapter"] == into["source"], "left").select(F.coalesce("target", "chapter").alias("to"), F.col("target").isNotNull().alias("late"), "chapter", "photo_id", "place")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("to", "photo_id").orderBy("late", "chapter", "place"))).where("nth = 1")
    return first.select(F.col("to").alias("chapter"), "photo_id", (F.row_number().over(Window.partitionBy("to").orderBy("late", F.col("chapter"), "place")) - 1).alias("place"))


def edited(chapters: DataFrame, touched: DataFrame) -> DataFrame:
    """chapters, of which those that users changed lose what clustering said of them: source, version, quality, review and explanation."""
    kinds = dict(chapters.dtypes)
    hand = chapters.join(touched.select("chapter").distinct().withColumn("_hand", F.lit(True)), "chapter", "left")
    over = {"source": F.lit("user"), "version": F.lit(None).cast(kinds["version"]), "quality": F.lit(None).cast(kinds["quality"]), "needs_review": F.lit(False), "explanation": F.lit(None).cast(kinds["explanation"])}
    return hand.withColumns({c: F.when(F.col("_hand"), v).otherwise(F.col(c)) for c, v in over.items()}).select(chapters.columns)
