"""MIME types: lookups between file extension and type, and the media class."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extension -> MIME type
MIME_TYPES = {
    "7z": "application/x-7z-compressed",
    "aac": "audio/aac",
    "ai": "application/postscript",
    "appcache": "text/cache-manifest",
    "asc": "text/plain",
    "atom": "application/atom+xml",
    "avi": "video/x-msvideo",
    "bin": "application/octet-stream",
    "bmp": "image/bmp",
    "bz2": "application/x-bzip",
    "class": "application/octet-stream",
    "cer": "application/pkix-cert",
    "crl": "application/pkix-crl",
    "crt": "application/x-x509-ca-cert",
    "css": "text/css",
    "csv": "text/csv",
    "deb": "application/x-deb",
    "dart": "application/dart",
    "dll": "application/octet-stream",
    "dmg": "application/octet-stream",
    "dms": "application/octet-stream",
    "doc": "application/msword",
    "dvi": "application/x-dvi",
    "edn": "application/edn",
    "eot": "application/vnd.ms-fontobject",
    "eps": "application/postscript",
    "etx": "text/x-setext",
    "exe": "application/octet-stream",
    "flv": "video/x-flv",
    "flac": "audio/flac",
    "gif": "image/gif",
    "gz": "application/gzip",
    "htm": "text/html",
    "html": "text/html",
    "ico": "image/x-icon",
    "iso": "application/x-iso9660-image",
    "jar": "application/java-archive",
    "jpe": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript",
    "json": "application/json",
    "lha": "application/octet-stream",
    "lzh": "application/octet-stream",
    "mov": "video/quicktime",
    "m3u8": "application/x-mpegurl",
    "m4v": "video/mp4",
    "mjs": "text/javascript",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "mpd": "application/dash+xml",
    "mpe": "video/mpeg",
    "mpeg": "video/mpeg",
    "mpg": "video/mpeg",
    "oga": "audio/ogg",
    "ogg": "audio/ogg",
    "ogv": "video/ogg",
    "pbm": "image/x-portable-bitmap",
    "pdf": "application/pdf",
    "pgm": "image/x-portable-graymap",
    "png": "image/png",
    "pnm": "image/x-portable-anymap",
    "ppm": "image/x-portable-pixmap",
    "ppt": "application/vnd.ms-powerpoint",
    "ps": "application/postscript",
    "qt": "video/quicktime",
    "rar": "application/x-rar-compressed",
    "ras": "image/x-cmu-raster",
    "rb": "text/plain",
    "rd": "text/plain",
    "rss": "application/rss+xml",
    "rtf": "application/rtf",
    "sgm": "text/sgml",
    "sgml": "text/sgml",
    "svg": "image/svg+xml",
    "swf": "application/x-shockwave-flash",
    "tar": "application/x-tar",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "ts": "video/mp2t",
    "ttf": "application/x-font-ttf",
    "txt": "text/plain",
    "webm": "video/webm",
    "wmv": "video/x-ms-wmv",
    "woff": "application/font-woff",
    "xbm": "image/x-xbitmap",
    "xls": "application/vnd.ms-excel",
    "xml": "text/xml",
    "xpm": "image/x-xpixmap",
    "xwd": "image/x-xwindowdump",
    "zip": "application/zip",
}
DEFAULT_TYPE = "application/octet-stream"


def _literal_map(entries: dict[str, str]) -> Column:
    # all literals, so the optimizer folds it into one constant: no join, no broadcast
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def mime_type(filename: Column) -> Column:
    """MIME type of a file name by its extension, `application/octet-stream` when unknown."""
    ext = F.lower(F.regexp_extract(filename, r"^.*\.([^./\\]+)$", 1))
    known = F.try_element_at(_literal_map(MIME_TYPES), ext)
    return F.when(filename.isNotNull(), F.coalesce(known, F.lit(DEFAULT_TYPE)))


def extension_for(mime: Column) -> Column:
    """Extension for a MIME type: its subtype when that is a known extension, else the alphabetically
    first extension of the type, else the subtype."""
    first_ext: dict[str, str] = {}
    for ext in sorted(MIME_TYPES):
        first_ext.setdefault(MIME_TYPES[ext], ext)
    subtype = F.get(F.split(mime, "/"), 1)
    is_ext = F.try_element_at(_literal_map(MIME_TYPES), subtype).isNotNull()
    return F.when(is_ext, subtype).otherwise(
        F.coalesce(F.try_element_at(_literal_map(first_ext), mime), subtype)
    )


def media_class(content_type: Column, url: Column) -> Column:
    """`video`, `image` or null, from the content type or else from the url."""
    mime = F.coalesce(content_type, mime_type(url))
    return F.when(mime.startswith("video/"), "video").when(mime.startswith("image/"), "image")
