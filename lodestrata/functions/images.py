"""Figures in markdown: placeholders, analyses, caption types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "<!-- image -->"
REFERENCE = r"!\[[^\]]*\]\([^)]+\)"


def with_images(markdown: Column, images: Column) -> Column:
    """Each placeholder replaced by the image of its number (array of struct(caption, path)); others stay."""
    parts = F.split(markdown, PLACEHOLDER)

    def joined(held: Column, i: Column) -> Column:
        image = F.get(images, i - 1)
        mark = F.when(image.isNull(), F.lit(PLACEHOLDER)).otherwise(
            F.concat(F.lit("!["), F.coalesce(image["caption"], F.lit("")), F.lit("]("), image["path"], F.lit(")"))
        )
        return F.concat(held, mark, F.get(parts, i))

    n = F.size(parts)
    return F.when(n < 2, markdown).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.get(parts, F.lit(0)), joined))


def base_name(path: Column) -> Column:
    """File name of a path in either notation."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def path_variants(path: Column) -> list[Column]:
    """How a document may refer to an image, in the order of preference."""
    whole, name = F.replace(path, F.lit("\\"), F.lit("/")), base_name(path)
    parent = base_name(F.regexp_replace(whole, "/*[^/]*$", ""))
    return [whole, name, F.concat(parent, F.lit("/"), name), F.concat(F.lit("./"), parent, F.lit("/"), name)]


def with_analyses(markdown: Column, analyses: Column) -> Column:
    """Each image followed by its analysis, from array<struct(path, analysis)>.

    An image is found by the first variant of its path that the text refers to; images without an analysis
    or a reference leave the text as it is.
    """

    def put(held: Column, one: Column) -> Column:
        added = F.concat(F.lit("$1\n\n**[Image Analysis]:** "), F.regexp_replace(one["analysis"], r"([\\$])", r"\\$1"), F.lit("\n"))
        out = F.when(F.coalesce(one["analysis"], F.lit("")) == "", held)
        for variant in path_variants(one["path"]):
            pattern = F.concat(F.lit(r"(?d)(!\[.*?\]\(\Q"), variant, F.lit(r"\E\))"))
            out = out.when(F.regexp_like(held, pattern), F.regexp_replace(held, pattern, added))
        return out.otherwise(held)

    return F.aggregate(analyses, markdown, put)


def captioned_references(documents: DataFrame, images: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reference, caption): images (path, caption) met by the references of the documents.

    A reference, else its file name, meets the path variants of the images; of several images the better
    variant wins, then the smaller path. One equi-join on names, with one row a name on the images' side.
    """
    refs = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))).alias("reference"))
    whole = F.replace(F.regexp_extract("reference", r"\(([^)]+)\)$", 1), F.lit("\\"), F.lit("/"))
    asked = refs.select(key, "reference", F.posexplode(F.array_distinct(F.array(whole, base_name(whole)))).alias("try", "name"))
    known = images.select("path", "caption", F.posexplode(F.array_distinct(F.array(*path_variants(F.col("path"))))).alias("place", "name"))
    known = known.groupBy("name").agg(F.min_by(F.struct("path", "caption"), F.struct("place", "path")).alias("image"))
    met = asked.join(known, "name", "left")
    return met.groupBy(key, "reference").agg(F.min_by("image.caption", F.when(F.col("image").isNotNull(), F.col("try"))).alias("caption"))


def image_type(caption: Column) -> Column:
    """The first of these words that a caption has names its type; figure without any."""
    low = F.lower(caption)
    out = F.when(F.contains(low, F.lit("table")), "table")
    for word in ("diagram", "chart", "graph"):
        out = out.when(F.contains(low, F.lit(word)), word)
    return out.otherwise("figure")


def figure_labels(markdown: Column, ahead: int = 9) -> Column:
    """array<struct(image, label)>: for each placeholder line, by its number from 0, the first label `Figure n`
    that begins one of the next `ahead` lines; placeholders without one are left out."""
    lines = F.transform(F.split(markdown, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    places = F.filter(F.transform(lines, lambda x, i: F.when(x == PLACEHOLDER, i)), lambda i: i.isNotNull())
    label = lambda x: F.regexp_extract(x, r"(?i)^(Figure\s+\d+)", 1)
    first = lambda i: F.get(F.filter(F.transform(F.slice(lines, i + 2, F.lit(ahead)), label), lambda x: x != ""), F.lit(0))
    found = F.transform(places, lambda i, n: F.struct(n.alias("image"), first(i).alias("label")))
    return F.filter(found, lambda f: f["label"].isNotNull())
