"""Folders as tables of documents, images' dates, profiles, query journals and the sinks of results."""

from __future__ import annotations

import gzip
import json
import os
import re
import struct
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T

TEXT, CONVERTIBLE, IMAGES = ("md", "txt"), ("docx", "html", "pdf", "pptx", "xlsx"), ("jpeg", "jpg", "png", "tiff")
#: Folders that are never read, at any depth.
EXCLUDED = ("_backups", "_trash", "_index")


def read_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = TEXT + CONVERTIBLE, excluded: tuple[str, ...] = EXCLUDED, converter: Callable[[str, bytes], str | None] | None = None) -> DataFrame:
    """(doc_id, path, text, size, modified, key): every file of the kinds; doc_id is the path below the folder.

    Text files are UTF-8 with bad bytes replaced. Others go through ``converter`` (path, bytes); html has its tags stripped without one,
    the rest a null text. key changes with path, time and size, for ``unseen``.
    """
    pattern = "*.{" + ",".join(f"{k},{k.upper()}" for k in kinds) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = re.sub(r"^(file:)?/*", "/", folder.rstrip("/"))
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(root) + "/", "")
    files = files.withColumn("doc_id", below)
    if excluded:
        files = files.where(~F.col("doc_id").rlike("(^|/)(" + "|".join(map(re.escape, excluded)) + ")/"))
    ext = F.lower(F.regexp_extract("doc_id", r"\.([^./]+)$", 1))
    plain = _utf8("content")
    text = F.when(ext.isin(*TEXT), plain)
    if converter is None:
        stripped = F.regexp_replace(F.regexp_replace(plain, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]+>", " ")
        text = text.when(ext.isin("html", "htm"), F.trim(F.regexp_replace(stripped, r"\s+", " ")))
    else:
        text = text.otherwise(_converted(converter)("doc_id", "content"))
    key = F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    return files.select("doc_id", "path", text.alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), key.alias("key"))


def _utf8(column: str):
    @F.pandas_udf("string")
    def decoded(content):
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return decoded(column)


def _converted(converter: Callable[[str, bytes], str | None]):
    @F.pandas_udf("string")
    def run(paths, contents):
        import pandas as pd

        def one(path, content):
            try:
                return converter(path, bytes(content))
            except Exception:  # a file that can't be converted counts as ignored, it doesn't end the job
                return None

        return pd.Series([one(p, c) for p, c in zip(paths, contents)], dtype=object)

    return run


def unseen(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose key isn't in ``cache``."""
    return files.join(cache.select("key").distinct(), "key", "left_anti")


def ignored(files: DataFrame) -> DataFrame:
    """(kind, n): files that gave no text."""
    return files.where("text is null").groupBy(T.document_kind(F.col("doc_id")).alias("kind")).agg(F.count("*").alias("n"))


def needs_ocr(path, text, size, pages=None):
    """Images of 12 MB at most, and pdfs with little text, of ten ``pages`` at most where their number is known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    little = F.length(F.trim(F.coalesce(text, F.lit("")))) < T.SCAN_CHARS
    short = F.lit(True) if pages is None else F.coalesce(pages <= 10, F.lit(True))
    return (ext.isin(*IMAGES) & (size <= 12 << 20)) | ((ext == "pdf") & little & short)


def exif_date(data: bytes) -> str | None:
    """YYYY-MM-DD of a JPEG's DateTimeOriginal, else DateTime, from its first 128 KB; None if there is none from 1990 to 2100."""
    data, at = data[: 128 << 10], 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0":
            try:
                return _tiff_date(part[6:])
            except (struct.error, IndexError):
                return None
        at += 2 + size
    return None


def _tiff_date(tiff: bytes) -> str | None:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return None

    def entries(at: int) -> dict[int, tuple[int, int, bytes]]:
        (n,) = struct.unpack_from(order + "H", tiff, at)
        out = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
            out[tag] = (kind, count, tiff[at + 10 + 12 * i : at + 14 + 12 * i])
        return out

    def date(entry) -> str | None:
        if not entry or entry[0] != 2:
            return None
        (at,) = struct.unpack(order + "I", entry[2])
        m = re.match(rb"(\d{4}):(\d\d):(\d\d)", tiff[at : at + entry[1]])
        if not m:
            return None
        y, mo, d = (int(x) for x in m.groups())
        return f"{y:04}-{mo:02}-{d:02}" if 1990 <= y <= 2100 and 1 <= mo <= 12 and 1 <= d <= 31 else None

    (first,) = struct.unpack_from(order + "I", tiff, 4)
    main = entries(first)
    if 0x8769 in main:
        (at,) = struct.unpack(order + "I", main[0x8769][2])
        if found := date(entries(at).get(0x9003)):
            return found
    return date(main.get(0x0132))


def exif_dates(content):
    """``exif_date`` over a binary column."""

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda b: exif_date(bytes(b)) if b is not None else None)

    return run(content)


_PROFILE = {"roles": list, "types": dict, "refs": dict, "grids": dict, "grammar": dict}


def read_profile(source: str | dict) -> dict:
    """A profile from a JSON file or an object; unknown keys, wrong kinds and bad patterns are errors."""
    profile = json.loads(Path(source).read_text(encoding="utf-8")) if isinstance(source, str) else source
    if not isinstance(profile, dict):
        raise ValueError("a profile is an object")
    for key, value in profile.items():
        if key not in _PROFILE:
            raise ValueError(f"unknown key {key!r}; known: {', '.join(_PROFILE)}")
        if not isinstance(value, _PROFILE[key]):
            raise ValueError(f"{key!r} must be a {_PROFILE[key].__name__}")
    patterns = [r.get("pattern") if isinstance(r, dict) else None for r in profile.get("roles", [])]
    if None in patterns or any("role" not in r for r in profile.get("roles", [])):
        raise ValueError("each of 'roles' has a pattern and a role")
    patterns += [g["pattern"] for g in profile.get("grids", {}).values() if "pattern" in g] + [p for k, p in profile.get("refs", {}).items() if k == "pattern"]
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            raise ValueError(f"bad pattern {p!r}: {e}") from e
    return profile


def explain_profile(profile: dict) -> str:
    """A sentence for each thing that a profile changes."""
    said = [f"Folders like {r['pattern']} are {r['role']} entities." for r in profile.get("roles", [])]
    said += [f"Files .{k.lstrip('.')} are {v}." for k, v in profile.get("types", {}).items()]
    said += [f"Codes: {k} is {v}." for k, v in profile.get("refs", {}).items()]
    said += [f"Grid {k}: {v}." for k, v in profile.get("grids", {}).items()]
    said += [f"Grammar: {k} also has {', '.join(v)}." for k, v in profile.get("grammar", {}).items()]
    return "\n".join(said) or "The defaults hold."


class Journal:
    """Lines of JSON about queries; off without a path. It never fails a search, and is packed away beyond ``limit`` bytes."""

    def __init__(self, path: str | None, limit: int = 5 << 20):
        self.path, self.limit = path, limit

    def note(self, query: str, hits: list[dict], **options) -> None:
        if not self.path:
            return
        try:
            line = json.dumps({"t": time.time(), "pid": os.getpid(), "ppid": os.getppid(), "q": query, "opts": options, "hits": hits}, ensure_ascii=False, default=str)
            if os.path.exists(self.path) and os.path.getsize(self.path) + len(line) > self.limit:
                packed = f"{self.path}.{time.strftime('%Y%m%d-%H%M%S')}.gz"
                with open(self.path, "rb") as a, gzip.open(packed, "ab") as b:
                    b.write(a.read())
                os.remove(self.path)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")
        except OSError:
            return

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        """(t, pid, ppid, q, opts, hits); lines that aren't JSON are skipped."""
        schema = "t double, pid bigint, ppid bigint, q string, opts map<string,string>, hits array<map<string,string>>"
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def as_json(result: DataFrame) -> DataFrame:
    """One column of JSON, a line a row."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("value"))


def error_json(error: BaseException) -> str:
    """A failure as one line of JSON, for the error stream."""
    return json.dumps({"error": str(error) or type(error).__name__}, ensure_ascii=False)


def grid_png(values: list[int], side: int) -> bytes:
    """An int8 grid of side * side * 3 as a PNG."""
    import zlib

    pixels = bytes((v + 128) & 255 for v in values)
    if len(pixels) != side * side * 3:
        raise ValueError("the grid isn't side * side * 3")
    rows = b"".join(b"\0" + pixels[y * side * 3 : (y + 1) * side * 3] for y in range(side))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def card_html(cards: list[dict], title: str) -> str:
    """A page of documents and their concepts with bars; ``cards``: [{id, concepts: [(word, weight)]}]."""
    from html import escape

    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for card in cards:
        most = max((w for _, w in card["concepts"]), default=1) or 1
        bars = "".join(f'<li>{escape(c)} <span style="display:inline-block;height:.6em;background:#58a;width:{round(100 * w / most)}px"></span></li>' for c, w in card["concepts"])
        out.append(f"<h2>{escape(str(card['id']))}</h2><ul>{bars}</ul>")
    return "\n".join(out)
