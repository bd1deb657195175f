"""Header harvest: image file -> keyword map -> normalized frame columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.config import DEFAULTS
from nightledger.functions.scoring import pixel_scale
from nightledger.functions.spatial import coord_sep_arcmin
from nightledger.functions.text import file_name
from nightledger.functions.wcs import SOLUTION, with_plate_solution

# For each field, the header keywords tried in order.
ALIASES = {
    "object": ["OBJECT"],
    "imagetyp": ["IMAGETYP", "FRAME", "FRAMETYPE"],
    "date_obs": ["DATE-OBS", "DATE_OBS", "DATE"],
    "exptime": ["EXPTIME", "EXPOSURE", "EXP_TIME"],
    "focal_length": ["FOCALLEN", "FOCAL", "FOCAL_LENGTH", "TELFOCAL"],
    "telescop": ["TELESCOP", "TELESCOPE"],
    "instrume": ["INSTRUME", "INSTRUMENT", "CAMERA"],
    "filter": ["FILTER", "FILTER1"],
    "bayer": ["BAYERPAT", "BAYERPATTERN", "COLORTYP"],
    "ra": ["RA", "RA_DEG", "CRVAL1"],
    "dec": ["DEC", "DEC_DEG", "CRVAL2"],
    "gain": ["GAIN", "EGAIN", "GAIN1"],
    "cam_offset": ["OFFSET", "PEDESTAL", "BLKLEVEL"],
    "ccd_temp": ["CCD-TEMP", "CCD_TEMP", "CCDTEMP", "SET-TEMP"],
    "set_temp": ["SET-TEMP", "SET_TEMP", "SETTEMP"],
    "xbinning": ["XBINNING", "BINX", "HBIN"],
    "ybinning": ["YBINNING", "BINY", "VBIN"],
    "naxis1": ["NAXIS1"],
    "naxis2": ["NAXIS2"],
    "pixsz": ["XPIXSZ", "PIXSIZE1", "PIXSIZE", "XPIXELSZ"],
    "site_lat": ["SITELAT", "LAT-OBS", "LATITUDE", "OBSGEO-B"],
    "site_lon": ["SITELONG", "LONG-OBS", "LONGITUD", "LONGITUDE", "OBSGEO-L"],
    "site_elev": ["SITEELEV", "ALT-OBS", "ELEVATIO", "HEIGHT", "OBSGEO-H"],
}
FLOAT_FIELDS = [
    "exptime", "focal_length", "ra", "dec", "gain", "ccd_temp", "set_temp", "pixsz", "site_lat", "site_lon", "site_elev",
]
INT_FIELDS = ["cam_offset", "xbinning", "ybinning", "naxis1", "naxis2"]

# Spellings of an image type -> canonical name.
IMAGE_TYPES = {
    "light": "Light Frame", "light frame": "Light Frame", "lframe": "Light Frame", "science": "Light Frame",
    "dark": "Dark Frame", "dark frame": "Dark Frame", "dframe": "Dark Frame",
    "flat": "Flat Frame", "flat frame": "Flat Frame", "flat field": "Flat Frame", "sky flat": "Flat Frame",
    "bias": "Bias Frame", "bias frame": "Bias Frame", "offset": "Bias Frame", "zero": "Bias Frame",
}
# Spellings of a filter -> canonical name.
FILTERS = {
    "l": "L", "lum": "L", "luminance": "L",
    "r": "R", "red": "R",
    "g": "G", "green": "G",
    "b": "B", "blue": "B",
    "h": "Ha", "ha": "Ha", "halpha": "Ha", "h-alpha": "Ha", "h_alpha": "Ha", "h-a": "Ha",
    "o": "OIII", "o3": "OIII", "oiii": "OIII", "o-iii": "OIII",
    "s": "SII", "s2": "SII", "sii": "SII", "s-ii": "SII",
    "clear": "Clear",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.create_map(*pairs)[key]


def normalize_imagetyp(value: Column) -> Column:
    v = F.trim(value)
    return F.coalesce(_lookup(IMAGE_TYPES, F.lower(v)), v)


def normalize_filter(value: Column) -> Column:
    v = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(_lookup(FILTERS, F.lower(v)), v)


def normalize_stored(frames: DataFrame) -> DataFrame:
    """Apply both spellings tables to rows already in the catalogue."""
    return frames.withColumn("imagetyp", normalize_imagetyp(F.col("imagetyp"))).withColumn(
        "filter", normalize_filter(F.col("filter"))
    )


# -- cards -----------------------------------------------------------------------

_BLOCK = 2880
_CARD = 80
#: Names of files with a header of cards.
IMAGE_FILE = re.compile(r"\.(fit|fits|fts)$", re.IGNORECASE)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, modificationTime, length) of the FITS files below a folder; no content is read."""
    roots = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "modificationTime", "length")
    return _image_paths(files)


def _image_paths(files: DataFrame) -> DataFrame:
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return files.filter(F.lower("path").rlike(r"\.(fit|fits|fts)$"))


def harvest_headers(spark: SparkSession, path: str | list[str], listing: DataFrame | None = None) -> DataFrame:
    """Header cards of FITS files: (path, mtime, length, cards, texts, error); see `parse_headers`."""
    files = list_files(spark, path)
    if listing is not None:
        files = files.join(listing.select("path"), "path", "left_semi")
    return parse_headers(read_heads(files))


def head_of(path: str) -> bytes | None:
    """Header blocks of a file up to its END card, however many there are, and nothing behind them; None if it cannot be opened."""
    from pyarrow import fs

    head = b""
    try:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(inner) as stream:
            while True:
                block = stream.read(_BLOCK)
                head += block
                ended = any(block[i : i + 8].rstrip() == b"END" for i in range(0, _BLOCK, _CARD))
                # Without a header at its start, the pixels of another format are left alone.
                if len(block) < _BLOCK or ended or not head.startswith(b"SIMPLE"):
                    return head
    except OSError:
        return None


def read_heads(files: DataFrame) -> DataFrame:
    """Adds `head`, the header blocks of each file, read through pyarrow's file systems by the tasks that need them."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(head=[head_of(p) for p in pdf["path"]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(run, f"{fields}, head binary")


def parse_headers(files: DataFrame) -> DataFrame:
    """Cards of header bytes: (path, mtime, length, cards, texts, error) from (path, modificationTime, length, head).

    `cards` maps a keyword to its value's text, `texts` lists the keywords whose value is a quoted text.  Long texts are
    put together from their CONTINUE cards; a HIERARCH card's keyword is what stands before its equals sign.
    Repeated keywords (COMMENT, HISTORY) keep their last value.  Without an END card there is an `error`.
    """
    head = files.select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", "head")
    head = head.withColumn("_keys", _keys_of("head")).withColumn("_end", F.array_position("_keys", "END").cast("int"))
    head = _continued(head.withColumn("_body", _cards("head", "_keys", "_end")), "_body")
    # The last card of a repeated keyword: sorted by keyword and place, the one before another keyword.
    # What a later step asks for more than once is a field of the step before: a lambda works out every mention of a column again.
    raw = F.transform("_body", lambda c: F.struct(c.alias("card"), card_key(c).alias("key"), _raw_value(c).alias("raw")))
    marked = F.transform(raw, lambda e: F.struct(e["card"].alias("card"), e["key"].alias("key"), e["raw"].alias("raw"), _is_quoted(e["raw"]).alias("quoted")))
    entry = lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), _value_of(e["card"], e["raw"], e["quoted"]).alias("value"), F.coalesce(e["quoted"], F.lit(True)).alias("text"))
    head = head.withColumn("_entries", F.sort_array(F.transform(marked, entry)))
    last = lambda e, i: ~e["key"].eqNullSafe(F.get("_entries", i + 1)["key"])
    head = head.withColumn("_entries", F.sort_array(F.transform(F.filter("_entries", last), lambda e: F.struct(e["place"], e["key"], e["value"], e["text"]))))
    readable = (F.col("_end") > 0) & F.get("_keys", F.lit(0)).startswith("SIMPLE")
    return head.select(
        "path", "mtime", "length",
        F.when(readable, F.map_from_entries(F.transform("_entries", lambda e: F.struct(e["key"], e["value"])))).alias("cards"),
        F.when(readable, F.transform(F.filter("_entries", lambda e: e["text"]), lambda e: e["key"])).alias("texts"),
        F.when(~F.coalesce(readable, F.lit(False)), F.lit("OSError: no FITS header found")).alias("error"),
    )


def _keys_of(head: str) -> Column:
    """The first 8 bytes of every card of a header, without blanks at their end.  Bytes are cut where they stand; no text is searched."""
    last = F.greatest(F.ceil(F.length(head) / _CARD).cast("int") - 1, F.lit(0))
    return _with(head, lambda whole: F.transform(F.sequence(F.lit(0), last), lambda i: F.rtrim(whole.substr(i * _CARD + 1, F.lit(8)).cast("string"))))


def _cards(head: str, keys: str, end: str) -> Column:
    """The 80-character cards before the END card, which is at position `end` (0: none), but for blank ones."""
    before = F.slice(keys, F.lit(1), F.greatest(F.col(end) - 1, F.lit(0)))
    places = F.filter(F.transform(before, lambda k, i: F.when(k != "", i)), lambda i: i.isNotNull())
    return _with(head, lambda whole: F.transform(places, lambda i: F.decode(whole.substr(i * _CARD + 1, F.lit(_CARD)), "ISO-8859-1")))


def _with(column: str, of: Callable[[Column], Column]) -> Column:
    """`of` a binary column, which is taken out of its row once: as a plain column it would be copied whole for each mention in a lambda."""
    return F.get(F.transform(F.array(column), of), F.lit(0))


_QUOTED = r"^\s*'([^']*+(?:''[^']*+)*+)'"


def _continued(head: DataFrame, cards: str) -> DataFrame:
    """CONTINUE cards of a column of cards appended to the text before them, which ends in an ampersand.

    Whether a card goes on with the one before can be seen from the two; the others begin a group, and each group is
    put together on its own.
    """
    open_text = r"&\s*'[^']*$"

    def rest(card: Column) -> Column:
        return F.regexp_extract(F.substring(card, 9, 72), r"^\s*'(.*)$", 1)

    def begins(card: Column, i: Column) -> Column:
        before = F.get(cards, i - 1)
        return ~(card.startswith("CONTINUE") & F.coalesce(before.rlike(open_text), F.lit(False)) & (rest(card) != ""))

    def group(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("_starts", i + 1), F.size(cards))
        more = F.slice(cards, start + 2, stop - start - 1)
        return F.aggregate(more, F.get(cards, start), lambda text, card: F.concat(F.regexp_replace(text, open_text, ""), rest(card)))

    flagged = head.withColumn("_begins", F.transform(cards, begins))
    flagged = flagged.withColumn("_starts", F.filter(F.transform("_begins", lambda b, i: F.when(b, i)), lambda i: i.isNotNull()))
    whole = F.when(F.size("_starts") == F.size(cards), F.col(cards)).otherwise(F.transform("_starts", group))
    return flagged.withColumn(cards, whole).drop("_begins", "_starts")


#: A card of another kind is told from its first letters, without a search.
_HIERARCH = r"^HIERARCH\s+([^=']+?)\s*=(.*)$"


def _is_hierarch(card: Column) -> Column:
    return card.startswith("HIERARCH") & card.rlike(_HIERARCH)


def card_key(card: Column) -> Column:
    return F.when(_is_hierarch(card), F.regexp_extract(card, _HIERARCH, 1)).otherwise(F.trim(F.substring(card, 1, 8)))


def _raw_value(card: Column) -> Column:
    """What stands behind the equals sign; NULL for a commentary card."""
    plain = F.when(F.substring(card, 9, 2) == "= ", F.substring(card, 11, 1_000_000))
    return F.when(_is_hierarch(card), F.regexp_extract(card, _HIERARCH, 2)).otherwise(plain)


def _is_quoted(raw: Column) -> Column:
    return F.ltrim(raw).startswith("'") | raw.rlike(r"^\s*'")


def is_text(card: Column) -> Column:
    """Is the value a quoted text?  Commentary is text too."""
    return F.coalesce(_is_quoted(_raw_value(card)), F.lit(True))


def card_value(card: Column) -> Column:
    """Value text of one card: quotes removed, doubled quotes undone, comment
    dropped; T and F stay as written.  Commentary cards keep their text."""
    return _value_of(card, _raw_value(card), _is_quoted(_raw_value(card)))


def _value_of(card: Column, raw: Column, quoted: Column) -> Column:
    text = F.rtrim(F.replace(F.regexp_extract(raw, _QUOTED, 1), F.lit("''"), F.lit("'")))
    value = F.when(quoted, text).otherwise(F.nullif(F.trim(F.substring_index(raw, "/", 1)), F.lit("")))
    return F.when(raw.isNotNull(), value).otherwise(F.trim(F.substring(card, 9, 72)))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$"


def _json_text(text: Column) -> Column:
    """A text in quotes; only one with a quote, a backslash or a control character needs the JSON writer."""
    escaped = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def header_json(cards: Column, texts: Column | None = None) -> Column:
    """The cards as a JSON object with numbers and booleans typed; the values of `texts` stay text, whatever they look like."""
    texts = F.coalesce(texts, F.array().cast("array<string>")) if texts is not None else F.array().cast("array<string>")
    items = F.transform(
        F.map_entries(cards),
        lambda e: F.concat(
            _json_text(e["key"]),
            F.lit(": "),
            F.when(e["value"].isNull(), F.lit("null"))
            .when(F.array_contains(texts, e["key"]), _json_text(e["value"]))
            .when(e["value"] == "T", F.lit("true"))
            .when(e["value"] == "F", F.lit("false"))
            .when(e["value"].rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), e["value"])
            .when(e["value"].rlike(_NUMBER), F.translate(e["value"], "dD", "ee").cast("double").cast("string"))
            .otherwise(_json_text(e["value"])),
        ),
    )
    return F.when(cards.isNotNull(), F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")))


def _number(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"(?<=[0-9.])[dD](?=[+-]?[0-9]+$)", "e").try_cast("double")


def normalize_headers(headers: DataFrame) -> DataFrame:
    """Frame fields from the keyword map.

    The first alias present, not NULL and not empty wins.  Text that is not a
    number becomes NULL in a number field.  In an integer field a number loses
    its fraction and a quoted text must be an integer; without `texts`, which
    names the quoted ones, a fraction gives NULL.  Exponents may be written with a D.
    """
    cards = F.col("cards")
    quoted = F.coalesce(F.col("texts"), F.array().cast("array<string>")) if "texts" in headers.columns else None

    def whole(field: str) -> Column:
        value, number = F.col(f"_{field}"), _number(F.col(f"_{field}"))
        if quoted is None:
            return F.when(number == F.floor(number), number.try_cast("int"))
        is_quoted = F.coalesce(*[F.when(F.nullif(cards[k], F.lit("")).isNotNull(), F.array_contains(quoted, k)) for k in ALIASES[field]])
        return F.when(is_quoted, F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("int"))).otherwise(number.try_cast("int"))

    def first(field: str) -> Column:
        return F.coalesce(*[F.nullif(cards[k], F.lit("")) for k in ALIASES[field]])

    raw = headers.select("*", *[first(f).alias(f"_{f}") for f in ALIASES])
    out = {}
    for field in ALIASES:
        v = F.col(f"_{field}")
        if field in FLOAT_FIELDS:
            d = _number(v)
            out[field] = F.when(~F.isnan(d), d)
        elif field in INT_FIELDS:
            out[field] = whole(field)
        elif field == "imagetyp":
            out[field] = normalize_imagetyp(v)
        elif field == "filter":
            out[field] = normalize_filter(v)
        else:
            out[field] = v
    drop = [f"_{f}" for f in ALIASES]
    return raw.withColumns(out).drop(*drop)


def frames_from_headers(headers: DataFrame) -> DataFrame:
    """Catalogue rows from harvested headers: fields, scale, plate solution
    and header JSON; unreadable files become tombstones."""
    f = with_plate_solution(normalize_headers(headers))
    readable = F.col("cards").isNotNull()
    error = F.substring(F.col("error"), 1, DEFAULTS.error_text_max) if "error" in headers.columns else F.lit(None).cast("string")
    f = f.withColumns({c: F.when(readable, F.col(c)) for c in SOLUTION})
    return f.withColumns({
        "filename": file_name(F.col("path")),
        "file_size": F.col("length").cast("long"),
        "file_mtime": F.col("mtime"),
        "index_error": error,
        "pixel_scale": pixel_scale(F.col("pixsz"), F.col("focal_length"), F.col("xbinning")),
        "coord_sep_arcmin": coord_sep_arcmin(F.col("ra"), F.col("dec"), F.col("wcs_ra"), F.col("wcs_dec")),
        "header_json": header_json(F.col("cards"), F.col("texts") if "texts" in headers.columns else None),
    }).drop("mtime", "length", "error", "texts")
