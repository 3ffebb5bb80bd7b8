"""Page layout and images: regions, reading order, near-duplicate images, placement, OCR lines and their quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regions(blocks: DataFrame) -> DataFrame:
    """blocks(doc, page, width, height, x0, y0, x1, y1, text) with region number and kind.

    In the order of (y0, x0), a block of 70 % of the page's width is a region of its own; a vertical gap of more
    than 3 % of the height below everything so far starts another.
    """
    page = Window.partitionBy("doc", "page").orderBy("y0", "x0", "y1", "x1", "text")
    wide = (F.col("x1") - F.col("x0")) >= 0.70 * F.col("width")
    rows = blocks.withColumn("wide", wide)
    below = F.max("y1").over(page.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("wide").over(page)
    opens = F.coalesce(F.col("wide") | before | (F.col("y0") - below > 0.03 * F.col("height")), F.lit(True))
    rows = rows.withColumn("opens", opens.cast("int"))
    return rows.withColumn("region", F.sum("opens").over(page)).drop("opens")


def two_column(with_regions: DataFrame) -> DataFrame:
    """(doc, page, region, two_column): two blocks on either side at least, a quarter crossing the middle at most."""
    mid = F.col("width") / 2
    counted = ~F.col("wide") & ((F.col("x1") - F.col("x0")) >= 0.08 * F.col("width"))
    crossing = counted & (F.col("x0") < mid) & (F.col("x1") > mid)
    left = counted & ~crossing & ((F.col("x0") + F.col("x1")) / 2 < mid)
    right = counted & ~crossing & ~left
    sums = with_regions.groupBy("doc", "page", "region").agg(F.count_if(crossing).alias("c"), F.count_if(left).alias("l"), F.count_if(right).alias("r"))
    return sums.select("doc", "page", "region", ((F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("c") <= 0.25 * (F.col("c") + F.col("l") + F.col("r")))).alias("two_column"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc, page, text, has_two_columns): blocks of a page region by region; in two-column ones the left side first."""
    rows = regions(blocks)
    rows = rows.join(two_column(rows), ["doc", "page", "region"])
    right = F.col("two_column") & ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") / 2)
    key = F.struct("region", right.alias("right"), "y0", "x0", "text")
    return rows.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), "\n\n").alias("text"), F.bool_or("two_column").alias("has_two_columns"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 256-bit hashes in hexadecimal."""
    part = lambda h, i: F.conv(F.substring(h, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(1, 4)), F.bit_count(part(a, 0).bitwiseXOR(part(b, 0))))


def image_groups(images: DataFrame, bits: int = 6, aspect: float = 0.01) -> DataFrame:
    """images(doc, position, image_id, visual_hash, width, height) -> doc, image_id, kept_id.

    In order of position, an image joins the first kept one within `bits` and `aspect`; the larger takes the place.
    The choice depends on the order, so a document's images are walked together; they are as many as one file holds.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        slot = []
        for row in pdf.sort_values(["position", "image_id"]).to_dict("records"):
            code, shape = int(row["visual_hash"], 16), row["width"] / row["height"]
            at = next((i for i, k in enumerate(kept) if abs(shape - k["shape"]) <= aspect and (code ^ k["code"]).bit_count() <= bits), None)
            mine = {"code": code, "shape": shape, "area": row["width"] * row["height"], "id": row["image_id"]}
            if at is None:
                at = len(kept)
                kept.append(mine)
            elif mine["area"] > kept[at]["area"]:
                kept[at] = mine
            slot.append((row["doc"], row["image_id"], at))
        return pd.DataFrame([(d, i, kept[at]["id"]) for d, i, at in slot], columns=["doc", "image_id", "kept_id"])

    return images.groupBy("doc").applyInPandas(walk, "doc string, image_id string, kept_id string")


def split_across_pages(bottom_pages: Column, top_pages: Column) -> Column:
    return F.arrays_overlap(F.transform(bottom_pages, lambda p: p + 1), top_pages)


def visible_fraction(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    inside = F.greatest(F.least(x1, width) - F.greatest(x0, F.lit(0.0)), F.lit(0.0)) * F.greatest(F.least(y1, height) - F.greatest(y0, F.lit(0.0)), F.lit(0.0))
    return F.coalesce(inside / F.nullif((x1 - x0) * (y1 - y0), F.lit(0.0)), F.lit(0.0))


def clipped(images: DataFrame) -> DataFrame:
    """images with boxes cut to their page."""
    inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most))
    return images.withColumns({"ix0": inside("ix0", "width"), "iy0": inside("iy0", "height"), "ix1": inside("ix1", "width"), "iy1": inside("iy1", "height")})


def nearest_blocks(images: DataFrame, blocks: DataFrame, n: int = 5) -> DataFrame:
    """images(doc, page, image_id, ix0..iy1, width, height) and blocks(doc, page, x0..y1, text): the n nearest blocks
    of each image on its page, with relation and distance. Image boxes are cut to the page first; blocks that a
    column `boilerplate` marks are left out."""
    kept = blocks.where("NOT coalesce(boilerplate, false)") if "boilerplate" in blocks.columns else blocks
    j = clipped(images).join(kept, ["doc", "page"])
    length = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1.0))
    over = lambda a0, a1, b0, b1: F.greatest(F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)), F.lit(0.0)) / F.least(length(a0, a1), length(b0, b1))
    v, h = over("iy0", "iy1", "y0", "y1"), over("ix0", "ix1", "x0", "x1")
    gap_x = F.greatest(F.col("x0") - F.col("ix1"), F.col("ix0") - F.col("x1"), F.lit(0.0)) / F.col("width")
    gap_y = F.greatest(F.col("y0") - F.col("iy1"), F.col("iy0") - F.col("y1"), F.lit(0.0)) / F.col("height")
    dx = ((F.col("x0") + F.col("x1")) - (F.col("ix0") + F.col("ix1"))) / 2 / F.col("width")
    dy = ((F.col("y0") + F.col("y1")) - (F.col("iy0") + F.col("iy1"))) / 2 / F.col("height")
    below = F.col("y0") >= F.col("iy1")
    relation = F.when(v > 0.25, "beside").when((h > 0.25) & below, "below").when(h > 0.25, "above").otherwise("diagonal")
    far = F.when(v > 0.25, gap_x - 0.12 * v).when(h > 0.25, gap_y + F.when(below, 0.08).otherwise(0.12) - 0.12 * h).otherwise(F.sqrt(dx * dx + dy * dy) + 0.25)
    rows = j.withColumn("relation", relation).withColumn("distance", F.greatest(F.lit(0.0), far))
    place = F.row_number().over(Window.partitionBy("doc", "image_id").orderBy("distance", "y0", "x0", "text"))
    return rows.withColumn("nth", place).where(F.col("nth") <= n).select("doc", "page", "image_id", "nth", "relation", "distance", "text")


def heading_level(text: Column) -> Column:
    """1, 2 or null, by prefix, capitals and words."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    tokens = F.size(F.split(line, " "))
    letters = F.regexp_replace(line, r"\P{L}", "")
    capitals = F.length(F.regexp_replace(letters, r"\P{Lu}", "")) / F.nullif(F.length(letters), F.lit(0))
    words = F.regexp_extract_all(line, F.lit(r"\p{L}+"), F.lit(0))
    long = F.filter(words, lambda w: F.length(w) > 2)
    upper = F.size(F.filter(long, lambda w: w.rlike(r"^\p{Lu}"))) / F.nullif(F.size(long), F.lit(0))
    return (
        F.when((line == "") | (F.length(line) > 180) | (tokens > 22), None).when(line.rlike(r"[.!?]$") & (tokens > 8), None)
        .when(line.rlike(r"^(?:\d+(?:\.\d+)*[.)]?|[IVXLCDM]+[.)]|[A-Z][.)])\s+\S"), 1).when(capitals >= 0.8, 1)
        .when(F.size(words).between(4, 14) & ~line.rlike("[:|]") & (upper >= 0.6), 2)
    )


def section_number(text: Column) -> Column:
    """The number that a heading starts with, '2.1' of '2.1) Scope'; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[.)]?\s+", 1), F.lit(""))


PAGES = 64  # of a document that one window holds


def sections_of(images: DataFrame, headings: DataFrame, pages: int = PAGES) -> DataFrame:
    """images(doc, image_id, page, y), headings(doc, page, y, level, title): the last level-1 heading at or before the
    image, else the last of any level, as section_title; one row for each image.

    An as-of lookup: both are put in one order, and the last seen is carried. A window holds so many pages of a document;
    what the pages before them end with is carried from block to block. A heading at the very place of an image counts,
    of several there the one with the largest title. Rows without doc, page or y have no section, and headings without a
    title are none.
    """
    block = F.floor(F.col("page") / pages).alias("block")
    marks = headings.where("doc IS NOT NULL AND page IS NOT NULL AND y IS NOT NULL AND title IS NOT NULL").select("doc", block, "page", "y", F.lit(0).alias("kind"), F.col("level").cast("int").alias("level"), F.col("title").cast("string").alias("title"), F.lit(None).cast("string").alias("image_id"))
    asked = images.select("doc", block, "page", "y", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), F.col("image_id").cast("string").alias("image_id"))
    place, main = F.struct("page", "y", "title"), F.col("level") == 1
    ends = marks.groupBy("doc", "block").agg(F.max_by("title", F.when(main, place)).alias("f"), F.max_by("title", place).alias("a"))
    upto = Window.partitionBy("doc").orderBy("block")
    within = Window.partitionBy("doc", "block").orderBy("page", "y", "kind", "title").rowsBetween(Window.unboundedPreceding, 0)
    # blocks without headings carry on what came before them
    blocks = asked.select("doc", "block").unionByName(marks.select("doc", "block")).distinct().join(ends, ["doc", "block"], "left")
    carried = blocks.select("doc", "block", *(F.last(c, True).over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in ("f", "a")))
    rows = marks.unionByName(asked).withColumn("first", F.last(F.when(main, F.col("title")), True).over(within)).withColumn("any", F.last("title", True).over(within))
    found = rows.where("kind = 1").join(carried, ["doc", "block"], "left")
    title = F.coalesce("first", "f", "any", "a")
    return found.select("doc", "image_id", F.when(F.col("doc").isNotNull() & F.col("page").isNotNull() & F.col("y").isNotNull(), title).alias("section_title"))


def ocr_lines(tsv: DataFrame, least: float = 45.0) -> DataFrame:
    """tsv(image_id, line_at, line): rows of twelve tab-separated fields -> image_id, text, words, confidence.

    Words of the least confidence or more are put together by page, block, paragraph and line, in the order of the
    rows; lines follow each other. Confidence is the mean over the image's words, to two places, halves to even.
    Rows that are shorter or hold no numbers where they should (a header too) are left out; an image without words
    has no row.
    """
    f = F.split("line", "\t", -1)
    place = [f[i].try_cast("int").alias(n) for i, n in ((1, "page"), (2, "block"), (3, "par"), (4, "line_no"))]
    rows = tsv.where(F.size(f) >= 12).select("image_id", "line_at", *place, f[10].try_cast("double").alias("conf"), F.regexp_replace(f[11], r"(?U)^\s+|\s+$", "").alias("word"))
    keys = ["page", "block", "par", "line_no"]
    kept = rows.where((F.col("conf") >= least) & (F.col("word") != "")).dropna(subset=keys)
    lines = kept.groupBy("image_id", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_at", "word"))), lambda x: x["word"]), " ").alias("text"), F.count("*").alias("n"), F.sum("conf").alias("c"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("image_id").agg(whole.alias("text"), F.sum("n").alias("words"), F.bround(F.sum("c") / F.sum("n"), 2).alias("confidence"))


VOWELS = "aeiouyàâäæçéèêëîïôöœùûüÿ"  # fixed: a Latin word without one of them is noise
_OCR_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
_CYRILLIC = ("rus", "srp", "ukr", "bul")


def _coherent(word: Column, languages: str) -> Column:
    """Four letters or more; of a script that a language has, Latin ones with a vowel."""
    codes, letters = set(languages.lower().split("+")), F.regexp_replace(word, r"\P{L}", "")
    by_script = F.when(letters.rlike(r"[\u0600-\u06FF]"), F.lit("ara" in codes)).when(letters.rlike(r"[\u0400-\u052F]"), F.lit(bool(codes & {*_CYRILLIC})))
    return (F.length(letters) >= 4) & by_script.otherwise(F.lower(letters).rlike(f"[{VOWELS}]"))


def ocr_quality(text: Column, confidence: Column, languages: str = "eng", length: int = 6, mean: float = 60.0, meaningful: int = 3) -> Column:
    """struct(meaningful, coherent, coherent_ratio, alphabetic_ratio, single_ratio, unsupported_ratio, reasons); no
    reasons, no objection. The names of the reasons and their limits are fixed."""
    codes = set(languages.lower().split("+"))
    n_letters = lambda c: F.length(F.regexp_replace(c, r"\P{L}", ""))
    allowed = r"\x{0}-\x{24F}" + (r"\u0600-\u06FF" if "ara" in codes else "") + (r"\u0400-\u052F" if codes & {*_CYRILLIC} else "")
    odd = F.length(F.regexp_replace(F.regexp_replace(text, r"\P{L}", ""), f"[{allowed}]", ""))
    of_words = lambda words: _once(F.filter(words, lambda w: n_letters(w) >= 2), lambda full: F.struct(
        F.size(words).alias("words"), F.size(F.filter(words, lambda w: F.length(w) == 1)).alias("single"), F.size(full).alias("full"), F.size(F.filter(full, lambda w: _coherent(w, languages))).alias("good"),
    ))
    seen = F.struct(
        _once(F.regexp_extract_all(text, F.lit(_OCR_WORD), F.lit(0)), of_words).alias("w"), n_letters(text).alias("letters"),
        F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")).alias("alnum"), odd.alias("odd"),
    )
    four = lambda c, n: F.bround(c, 4).alias(n)
    share = lambda a, b: a / F.greatest(F.lit(1), b)

    def judged(s: Column) -> Column:
        full, good = s["w"]["full"], s["w"]["good"]
        ratio, alphabetic, single, strange = share(good, full), share(s["letters"], s["alnum"]), share(s["w"]["single"], s["w"]["words"]), share(s["odd"], s["letters"])
        reasons = F.array_compact(F.array(
            F.when(F.length(text) < length, "too_short"), F.when(confidence.isNull() | (confidence < mean), "low_mean_confidence"),
            F.when(full < meaningful, "too_few_meaningful_words"), F.when(good < 4, "too_few_coherent_words"), F.when(ratio < 0.45, "low_coherent_word_ratio"),
            F.when(alphabetic < 0.65, "low_alphabetic_ratio"), F.when(single > 0.30, "too_many_single_character_tokens"), F.when(strange > 0.10, "unsupported_script_noise"),
        ))
        return F.struct(full.alias("meaningful"), good.alias("coherent"), four(ratio, "coherent_ratio"), four(alphabetic, "alphabetic_ratio"), four(single, "single_ratio"), four(strange, "unsupported_ratio"), reasons.alias("reasons"))

    return _once(seen, judged)


def _once(value: Column, use) -> Column:
    """`use` of a value that is worked out once, as a variable of a lambda, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_ocr(text: Column) -> Column:
    """Words cut at line ends put together, blanks collapsed, lines without letters or digits dropped."""
    whole = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x0c"), F.lit(" ")), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    lines = F.transform(F.split(F.regexp_replace(whole, r"[ \t]+", " "), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]")), "\n")


def document_label(file_name: Column) -> Column:
    """A file's name without its folder and ending, underscores and hyphens as blanks."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_\-]+", " "), r"(?U)\s+", " "))
