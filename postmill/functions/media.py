"""Media planning as columns: box fitting, file naming, conversion plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.mime import extension_for
from postmill.functions.text import file_extension
from postmill.functions.times import STAMP

# fixed values: largest stored and shown sizes
STORED_BOX = (1100, 1000)
SHOWN_BOX = (550, 500)
UPLOADS = "uploads/"


def _div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def is_upload(url: Column) -> Column:
    return url.startswith(UPLOADS)


def _scaled(w: Column, h: Column, box: tuple[int, int], step: int) -> Column:
    # exact integer arithmetic: each branch is a scale by a whole ratio, truncated to `step`
    max_w, max_h = (F.lit(side).cast("bigint") for side in box)

    def ratio(numerator: Column, denominator: Column) -> Column:
        return _div(numerator, denominator * step) * step

    def size(width: Column, height: Column) -> Column:
        return F.struct(width.alias("w"), height.alias("h"))

    one = F.lit(1).cast("bigint")
    return (
        F.when(
            (w > max_w) & (h * max_w > max_h * w), size(ratio(max_h * w, h), ratio(max_h, one))
        )
        .when(w > max_w, size(ratio(max_w, one), ratio(h * max_w, w)))
        .when(h > max_h, size(ratio(w * max_h, h), ratio(max_h, one)))
        .when(w.isNotNull() & h.isNotNull(), size(ratio(w, one), ratio(h, one)))
    )


def fit(w: Column, h: Column, box: tuple[int, int] = SHOWN_BOX) -> Column:
    """Size `struct<w, h>` inside the box with the aspect kept, fractions dropped."""
    return _scaled(w, h, box, 1)


def video_size(w: Column, h: Column) -> Column:
    """Target size of a converted video: fitted, each side rounded down to an even number."""
    return _scaled(w, h, STORED_BOX, 2)


def aspect_percent(w: Column, h: Column) -> Column:
    return h.cast("double") / w * 100


def published_path(year: Column, post_id: Column, version: Column, full: bool, ext: Column) -> Column:
    """`year/id[vN][_full].ext`, the version only from the second on."""
    tail = "_full." if full else "."
    return F.concat(
        year.cast("string"),
        F.lit("/"),
        post_id.cast("string"),
        F.when(version > 1, F.concat(F.lit("v"), version.cast("string"))).otherwise(""),
        F.lit(tail),
        ext,
    )


def legacy_path(year: Column, post_id: Column, full: bool, url: Column) -> Column:
    return F.format_string(
        "%s/%s_1%s.%s", year, post_id, F.lit("_full" if full else ""), file_extension(url)
    )


def upload_name(next_id: Column, now: Column, mime: Column) -> Column:
    return F.concat(
        next_id.cast("string"), F.lit("_"), F.date_format(now, STAMP), F.lit("_full."), extension_for(mime)
    )


def conversion_plan(name: Column, mime: Column, w: Column, h: Column) -> Column:
    """What an upload turns into: `struct<action, target_name, target_type, w, h, has_full>`.

    Videos become mp4; gifs and small jpegs stay as they are; other images become jpeg, shrunk if
    large. Anything else is an error.
    """
    large = (w > STORED_BOX[0]) | (h > STORED_BOX[1])
    fitted = fit(w, h, STORED_BOX)
    video = video_size(w, h)

    def plan(action: Column | str, target: Column, kind: Column, tw: Column, th: Column, full: bool) -> Column:
        action = F.lit(action) if isinstance(action, str) else action
        return F.struct(
            action.alias("action"),
            target.alias("target_name"),
            kind.alias("target_type"),
            tw.alias("w"),
            th.alias("h"),
            F.lit(full).alias("has_full"),
        )

    return (
        F.when(
            mime.startswith("video/"),
            plan("transcode", F.regexp_replace(name, r"^(.+)_full\.[a-z0-9]+$", "$1.mp4"),
                 F.lit("video/mp4"), video["w"], video["h"], True),
        )
        .when(~mime.startswith("image/"), F.raise_error(F.concat(F.lit("Unknown content-type: "), mime)))
        .when(
            (mime == "image/gif") | ((mime == "image/jpeg") & ~large),
            plan("keep", F.regexp_replace(name, r"^(.+)_full\.([a-z]+)$", "$1.$2"), mime, w, h, False),
        )
        .otherwise(
            plan(F.when(large, "resize").otherwise("convert"),
                 F.regexp_replace(name, r"^(.+)_full\.[a-z]+$", "$1.jpeg"),
                 F.lit("image/jpeg"), fitted["w"], fitted["h"], True)
        )
    )


def parse_probe(out: Column) -> Column:
    """`WxHxFrames` of a media probe as a struct; `N/A` is null, anything else an error."""
    pattern = r"^(\d+|N/A)x(\d+|N/A)x(\d+|N/A)"

    def part(i: int) -> Column:
        return F.regexp_extract(out, pattern, i).try_cast("bigint")

    return F.when(
        out.rlike(pattern), F.struct(part(1).alias("width"), part(2).alias("height"), part(3).alias("frames"))
    ).otherwise(F.raise_error(F.concat(F.lit("Unexpected probe output: "), out)))
