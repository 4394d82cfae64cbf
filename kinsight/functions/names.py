"""Column functions on paths and file names. Paths use backslashes and are relative to a volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by format tier, name patterns, folder hints.
RAW = (".cr2", ".cr3", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".dng", ".orf", ".rw2", ".raf", ".pef", ".srw", ".raw", ".rwl", ".3fr", ".iiq", ".x3f")
LOSSLESS = (".png", ".tif", ".tiff", ".bmp")
LOSSY = (".jpg", ".jpeg", ".jpe", ".jfif", ".heic", ".heif", ".avif", ".webp", ".gif")
TIERS = ("Unknown", "Lossy", "Lossless", "Raw")
GENERIC_NAME = r"(?i)^(img|dsc|dscn|photo|image|picture|untitled|unnamed|download|screenshot|received|fb_img|whatsapp|zalo|viber|scan|capture|_mg)[-_ ]?[0-9]*"
COPY_SUFFIX = r"(?i)(\([0-9]+\)|[-_ ]cop(y|ia)|[-_ ][0-9]+\s*-\s*cop(y|ia))$"
SERIES = r"^(.*?)([0-9]{2,6})$"
#: (name, pattern, format of the joined groups, source); the first that gives a plausible date wins.
DATE_PATTERNS = (
    ("android-camera", r"(?i)(?:IMG|VID|PANO|MVIMG)[_-]([0-9]{8})[_-]([0-9]{6})", "yyyyMMddHHmmss", "Camera"),
    ("pixel", r"(?i)PXL[_-]([0-9]{8})[_-]([0-9]{6})[0-9]*", "yyyyMMddHHmmss", "Camera"),
    ("date-time", r"(?:^|[^0-9])([0-9]{8})[_-]([0-9]{6})(?:[^0-9]|$)", "yyyyMMddHHmmss", "Camera"),
    ("whatsapp", r"(?i)(?:IMG|VID)-([0-9]{8})()-WA[0-9]+", "yyyyMMdd", "Messaging"),
    ("viber", r"(?i)viber_(?:image|video)_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{2}-[0-9]{2}-[0-9]{2})", "yyyy-MM-ddHH-mm-ss", "Messaging"),
    ("telegram", r"(?i)(?:photo|video)_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{2}-[0-9]{2}-[0-9]{2})", "yyyy-MM-ddHH-mm-ss", "Messaging"),
    ("signal", r"(?i)signal-([0-9]{4}-[0-9]{2}-[0-9]{2})-([0-9]{6})", "yyyy-MM-ddHHmmss", "Messaging"),
    ("screenshot", r"(?i)Screen(?:shot|_?Shot)[ _-]([0-9]{4}-?[0-9]{2}-?[0-9]{2})[ _-]([0-9]{2}-?[0-9]{2}-?[0-9]{2})", "yyyyMMddHHmmss", "Screenshot"),
    ("messenger", r"(?i)FB_IMG_([0-9]{13})()", "millis", "Messaging"),
)
SOURCE_HINTS = (
    (r"(?i)(?:^|[\\/])(?:Zalo|ZaloPC)[\\/]", "Messaging"),
    (r"(?i)(?:^|[\\/])(?:Messenger|WhatsApp|Viber|Telegram|Signal|Line|WeChat)[\\/]", "Messaging"),
    (r"(?i)(?:^|[\\/])Screenshots?[\\/]", "Screenshot"),
    (r"(?i)(?:^|[\\/])(?:Downloads?|Tai xuong)[\\/]", "Download"),
    (r"(?i)(?:^|[\\/])DCIM[\\/]", "Camera"),
)
EARLIEST = "1990-01-01"


def extension(name: Column) -> Column:
    """The last dot and what follows, lower case; null without any, for a leading dot, or with nothing behind it."""
    found = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def stem(name: Column) -> Column:
    """A file name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^\\/]*)$", 1), r"\.[^.]*$", "")


def tier(name: Column) -> Column:
    """Index into TIERS."""
    ext = extension(name)
    return F.when(ext.isin(*RAW), 3).when(ext.isin(*LOSSLESS), 2).when(ext.isin(*LOSSY), 1).otherwise(0)


def tier_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), number + 1)


def full_path(mount: Column, rel_path: Column) -> Column:
    return F.concat(F.when(mount.endswith("\\"), mount).otherwise(F.concat(mount, F.lit("\\"))), rel_path)


def folder_at(rel_path: Column, depth: int) -> Column:
    """The first folders of a path, ``depth`` at most; "(volume root)" for files that are in none."""
    parts = F.filter(F.split(rel_path, r"\\"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n <= 1, "(volume root)").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.least(F.lit(depth), n - 1))), "\\"))


def series(name: Column) -> Column:
    """struct<prefix, number> of names that end in two to six digits; both empty for others."""
    s = stem(name)
    return F.struct(F.regexp_extract(s, SERIES, 1).alias("prefix"), F.regexp_extract(s, SERIES, 2).alias("number"))


def different_frames(a: Column, b: Column) -> Column:
    """Two ``series`` with one prefix, case aside and not empty, and different numbers: two shots, not two copies."""
    return (a["prefix"] != "") & (a["number"] != "") & (b["number"] != "") & (F.lower(a["prefix"]) == F.lower(b["prefix"])) & (a["number"] != b["number"])


def source_of(path: Column) -> Column:
    chain = None
    for pattern, source in SOURCE_HINTS:
        hit = path.rlike(pattern)
        chain = F.when(hit, source) if chain is None else chain.when(hit, source)
    return chain.otherwise("Unknown")


def filename_facts(path: Column, now: str) -> Column:
    """struct<taken timestamp_ntz, pattern, source> of a path; ``now`` (a timestamp) bounds plausible dates to a day later."""
    name = stem(path)
    tries = []
    for label, pattern, form, source in DATE_PATTERNS:
        first, second = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
        joined = F.concat(first, second)
        if label == "screenshot":
            joined = F.replace(joined, F.lit("-"), F.lit(""))
        if form == "millis":
            at = F.timestamp_millis(joined.try_cast("bigint"))
        else:
            at = F.try_to_timestamp(F.when(joined != "", joined), F.lit(form))
        good = (at >= F.lit(EARLIEST).cast("timestamp")) & (at <= F.lit(now).cast("timestamp") + F.expr("interval 1 day"))
        tries.append(F.when(good, F.struct(at.cast("timestamp_ntz").alias("taken"), F.lit(label).alias("pattern"), F.lit(source).alias("own"))))
    whole = lambda f, hint: F.struct(
        f["taken"].alias("taken"), f["pattern"].alias("pattern"), F.when(hint != "Unknown", hint).otherwise(F.coalesce(f["own"], F.lit("Unknown"))).alias("source")
    )
    # inside a lambda the chain of patterns is a value, not an expression to be repeated in each field
    return F.get(F.zip_with(F.array(F.coalesce(*tries)), F.array(source_of(path)), whole), 0)


def camera(make: Column, model: Column) -> Column:
    """Make and model without a brand that both name."""
    word = F.element_at(F.filter(F.split(make, " "), lambda x: x != ""), 1)
    shared = F.lower(model).startswith(F.lower(make)) | ((F.length(word) >= 3) & F.lower(model).startswith(F.lower(word)))
    return F.when(make.isNull(), model).when(model.isNull(), make).when(F.coalesce(shared, F.lit(False)), model).otherwise(F.concat_ws(" ", make, model))


def is_inside(path: Column, root: Column) -> Column:
    """Whether a path is below a root, segment by segment; "." and ".." are resolved first, as far as names go. Above a drive there is nothing."""
    plain = lambda p: F.lower(F.rtrim(F.replace(p, F.lit("/"), F.lit("\\")), F.lit("\\")))

    def step(done: Column, segment: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        names = (F.size(done) > 0) & (last != "..") & (last != "")
        drive = (F.size(done) == 1) & last.endswith(":")
        up = F.when(drive, done).when(names, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(segment)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    up = F.array_join(F.aggregate(F.split(plain(path), r"\\"), F.array().cast("array<string>"), step), "\\")
    return up.startswith(F.concat(plain(root), F.lit("\\")))


def safe_name(name: Column) -> Column:
    """A volume's name as one folder: letters, digits, dash and underscore stay."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", "volume").otherwise(kept)


def folder_label(path: Column) -> Column:
    """The last three segments of a folder's path, with an ellipsis for those before."""
    parts = F.filter(F.split(path, r"\\"), lambda x: x != "")
    return F.when(F.size(parts) > 3, F.concat(F.lit("...\\"), F.array_join(F.slice(parts, -3, 3), "\\"))).otherwise(F.array_join(parts, "\\"))


def truncate(text: Column, most: int) -> Column:
    """A text of at most so many characters, the last of them an ellipsis where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("\u2026"))).otherwise(text)


def format_age(seconds: Column) -> Column:
    """Whole days from one day on, else hours, else minutes."""
    whole = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(mark))
    return F.when(seconds >= 86400, whole(86400, "d")).when(seconds >= 3600, whole(3600, "h")).otherwise(whole(60, "m"))


def format_bytes(n: int) -> str:
    size, units = float(n), ("B", "KB", "MB", "GB", "TB", "PB")
    for unit in units:
        if abs(size) < 1024 or unit == units[-1]:
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    raise AssertionError


def parse_size(text: str) -> int:
    """Bytes of "64KB", "1.5 G", "300": powers of 1024."""
    t = text.strip().upper()
    for unit, power in (("TB", 4), ("GB", 3), ("MB", 2), ("KB", 1), ("T", 4), ("G", 3), ("M", 2), ("K", 1), ("B", 0), ("", 0)):
        if t.endswith(unit):
            return int(float(t.removesuffix(unit).strip()) * 1024**power)
    raise ValueError(text)


def parse_duration(text: str) -> int:
    """Seconds of "14d", "36h", "30m" or "20s"."""
    t = text.strip().lower()
    unit = {"d": 86400, "h": 3600, "m": 60, "s": 1}.get(t[-1:])
    if unit is None:
        raise ValueError(text)
    return int(float(t[:-1]) * unit)
