"""What the header of a JPEG says, as column expressions over its bytes: no decoder, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments that are walked at most before the frame's size is met; and entries of an EXIF directory.
SEGMENTS, ENTRIES = 256, 256
#: The markers of frames (their sizes follow), those without a segment, and the tag of the orientation.
FRAMES = [f"FFC{k:X}" for k in range(16) if k not in (4, 8, 12)]
BARE = ["FF01", *(f"FFD{k}" for k in range(8))]
ORIENTATION = 0x0112


def _number(content: Column, at: Column, n: int, little: Column | None = None) -> Column:
    """The unsigned number of ``n`` bytes from place ``at`` on (the first is 1); big-endian, or as ``little`` says. Null past the end."""
    part = F.substring(content, at, F.lit(n))
    big = F.conv(F.hex(part), 16, 10).cast("long")
    if little is not None:
        turned = F.concat(*(F.substring(content, at + k, F.lit(1)) for k in reversed(range(n))))
        big = F.when(little, F.conv(F.hex(turned), 16, 10).cast("long")).otherwise(big)
    return F.when(F.length(part) == n, big)


def header(content: Column) -> Column:
    """``width, height, orientation, whole`` of a JPEG: the frame's size (null if none is met), EXIF's orientation (1 without), and whether the image data begins and ends."""
    size = F.length(content)
    start = F.struct(F.lit(3).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("long").alias("exif"), F.lit(None).cast("long").alias("scan"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker = F.hex(F.substring(content, at, F.lit(2)))
        length = _number(content, at + 2, 2)
        frame, scan = marker.isin(FRAMES), marker == "FFDA"
        # a segment that has no length or leaves the file ends the walk
        broken = (F.length(marker) < 4) | ~marker.startswith("FF") | (~marker.isin("FFFF", *BARE) & (F.coalesce(length, F.lit(0)) < 2)) | (at + 1 + F.coalesce(length, F.lit(0)) > size) & ~marker.isin("FFFF", *BARE)
        exif = (marker == "FFE1") & (F.substring(content, at + 4, F.lit(6)) == F.lit(b"Exif\0\0")) & s["exif"].isNull()
        on = F.when(marker == "FFFF", at + 1).when(marker.isin(BARE), at + 2).otherwise(at + 2 + length)
        after = F.struct(
            on.alias("at"), F.when(frame & s["width"].isNull(), _number(content, at + 7, 2)).otherwise(s["width"]).alias("width"), F.when(frame & s["height"].isNull(), _number(content, at + 5, 2)).otherwise(s["height"]).alias("height"),
            F.when(exif, at + 10).otherwise(s["exif"]).alias("exif"), F.when(scan, at).otherwise(s["scan"]).alias("scan"), scan.alias("done"),
        )
        return F.when(s["done"] | broken, s.withField("done", F.lit(True))).otherwise(after)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)
    return F.transform(F.array(walked), lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height"), F.coalesce(_orientation(content, s["exif"]), F.lit(1)).cast("int").alias("orientation"), _ends(content, s["scan"]).alias("whole")))[0]


def _ends(content: Column, scan: Column) -> Column:
    """Whether the end marker follows the scan; within image data no marker can stand by chance."""
    rest = F.hex(F.substring(content, scan, F.length(content)))
    return scan.isNotNull() & F.coalesce(rest.rlike("^(?:..)*?FFD9"), F.lit(False))


def _orientation(content: Column, tiff: Column) -> Column:
    """The orientation in the first directory of an EXIF block that begins at ``tiff``, if it is from 1 to 8."""
    little = F.substring(content, tiff, F.lit(2)) == F.lit(b"II")
    first = tiff + _number(content, tiff + 4, 4, little)
    n = F.least(_number(content, first, 2, little), F.lit(ENTRIES))
    tags = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda k: first + 2 + 12 * k), lambda e: _number(content, e, 2, little) == ORIENTATION)
    value = _number(content, F.get(tags, 0) + 8, 2, little)
    return F.when(tiff.isNotNull() & (n > 0) & value.between(1, 8), value)


def turn(orientation: Column) -> Column:
    """Degrees clockwise that bring an image upright."""
    return F.when(orientation.isin(3, 4), 180).when(orientation.isin(5, 6), 90).when(orientation.isin(7, 8), 270).otherwise(0)


def mirrored(orientation: Column) -> Column:
    """Whether it is mirrored then."""
    return orientation.isin(2, 4, 5, 7)
