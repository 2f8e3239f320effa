"""Images of postings before they are read: sizes from the first bytes, and the slices of tall ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: what a reader takes
MAX_WIDTH, CHUNK_H, OVERLAP, MAX_CHUNKS, MIN_SIDE = 1000, 1100, 40, 14, 200


def data_content(uri: Column) -> Column:
    """The bytes of a base64 data:image address; null for any other or a broken one."""
    return F.when(F.startswith(uri, F.lit("data:image/")), F.try_to_binary(F.substring_index(F.substring(uri, F.locate(",", uri) + 1, F.length(uri)), ",", -1), F.lit("base64")))


def _number(content: Column, begin: int, size: int, little: bool = False) -> Column:
    at = range(begin + size - 1, begin - 1, -1) if little else range(begin, begin + size)
    return F.conv(F.concat(*[F.hex(F.substring(content, i + 1, 1)) for i in at]), 16, 10).cast("int")


def image_size(content: Column) -> Column:
    """(width, height) as PNG and GIF have them in their first bytes; null for other formats, whose sizes come from whoever fetched them."""
    png = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(content) >= 24)
    gif = F.hex(F.substring(content, 1, 6)).isin("474946383761", "474946383961") & (F.octet_length(content) >= 10)
    pair = lambda *x: F.struct(_number(*x[0]).alias("width"), _number(*x[1]).alias("height"))
    return F.when(png, pair((content, 16, 4), (content, 20, 4))).when(gif, pair((content, 6, 2, True), (content, 8, 2, True)))


def slices(images: DataFrame, *, posting: str, ordinal: str, width: str = "width", height: str = "height", max_width: int = MAX_WIDTH, chunk: int = CHUNK_H, overlap: int = OVERLAP, most: int = MAX_CHUNKS, least_side: int = MIN_SIDE) -> DataFrame:
    """(posting, ordinal, part, width, top, bottom) of the slices of a posting's images, in the order of ordinal, parts from 0, most of them at most.

    Images with a side under least_side, or of unknown size, are logos or no images and give none. Wider ones shrink to max_width, heights rounded down. Slices are chunk high,
    and all but an image's first begin overlap higher. Images of one ordinal are read side by side: their slices alternate from the top, those of the narrower image first, of equal
    widths the lower one. Images past the most-th slice go before slices are made."""
    fits = F.least(F.col(width), F.col(height)) >= least_side
    wide = F.col(width) > max_width
    sized = images.filter(fits).select(posting, ordinal, F.when(wide, max_width).otherwise(F.col(width)).alias("width"), F.when(wide, F.floor(F.col(height) * max_width / F.col(width))).otherwise(F.col(height)).cast("int").alias("height"))
    parts = F.ceil(F.col("height") / chunk).cast("int")
    place = F.col(ordinal).asc_nulls_last()
    before = F.sum("parts").over(W.partitionBy(posting).orderBy(place)) - F.sum("parts").over(W.partitionBy(posting, ordinal))
    counted = sized.withColumn("parts", parts).withColumn("before", before).filter((F.col("before") < most) & (F.col("parts") > 0))
    cut = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("parts"), most - F.col("before")).cast("int") - 1)))
    numbered = cut.withColumn("part", F.row_number().over(W.partitionBy(posting).orderBy(place, "k", "width", "height")) - 1).filter(F.col("part") < most)
    top = F.col("k") * chunk
    return numbered.select(posting, ordinal, "part", "width", F.greatest(F.lit(0), top - overlap).alias("top"), F.least(F.col("height"), top + chunk).alias("bottom"))
