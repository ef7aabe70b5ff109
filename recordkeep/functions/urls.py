"""Addresses: validity, redirects, destinations, and the preview images that go with a cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters with public defaults: hosts that wrap a target in ``q``, and hosts of shared files and sheets.
REDIRECTORS = ("google.com", "www.google.com")
DRIVE_HOST, SHEET_HOST = "drive.google.com", "docs.google.com"
PREVIEWS = 18


def valid_url(c: Column) -> Column:
    """http or https with a host, and neither white space nor control characters."""
    return F.coalesce(c.rlike(r"^https?://[^/?#\s\x00-\x1f]+[^\s\x00-\x1f]*$") & ~c.rlike(r"(?U)\s"), F.lit(False))


def safe_url(c: Column) -> Column:
    """The trimmed address if it is valid, else null."""
    trimmed = F.trim(c)
    return F.when(valid_url(trimmed), trimmed)


def part(c: Column, name: str) -> Column:
    """PROTOCOL, HOST, PATH, QUERY or REF; host and protocol in lower case; null for what is no address."""
    found = F.try_parse_url(c, F.lit(name))
    return F.lower(found) if name in ("PROTOCOL", "HOST") else found


def query_values(c: Column, name: str) -> Column:
    """All decoded values of a query parameter."""
    raw = F.regexp_extract_all(F.concat(F.lit("&"), F.coalesce(part(c, "QUERY"), F.lit(""))), F.lit(f"&{name}=([^&]*)"), F.lit(1))
    return F.transform(raw, lambda v: F.try_url_decode(v))


def unwrap_redirect(c: Column, hosts: tuple[str, ...] = REDIRECTORS) -> Column:
    """The target of a redirector; null if that has not exactly one valid target; other addresses as they are."""
    wrapped = part(c, "HOST").isin(*hosts) & (part(c, "PATH") == "/url")
    targets = query_values(c, "q")
    target = F.when(F.size(targets) == 1, F.get(targets, F.lit(0)))
    return F.when(~valid_url(c), None).when(wrapped, F.when(valid_url(target), target)).otherwise(c)


def destination(c: Column, drive_host: str = DRIVE_HOST, sheet_host: str = SHEET_HOST) -> Column:
    """``drive`` (a shared file or folder), ``sheet`` or ``opaque``."""
    host, path = part(c, "HOST"), part(c, "PATH")
    ids = query_values(c, "id")
    opened = (path == "/open") & (F.size(ids) == 1) & F.get(ids, F.lit(0)).rlike("^[A-Za-z0-9_-]+$")
    drive = (host == drive_host) & (path.rlike("^/drive/folders/[A-Za-z0-9_-]+/?$") | path.rlike("^/file/d/[A-Za-z0-9_-]+(/.*)?$") | opened)
    sheet = (host == sheet_host) & path.rlike("^/spreadsheets/d/[A-Za-z0-9_-]+(/.*)?$")
    return F.when(drive, "drive").when(sheet, "sheet").otherwise("opaque")


def export_url(c: Column, sheet_host: str = SHEET_HOST) -> Column:
    """CSV export of a sheet: its id and the one tab that query and fragment name (0 if none); null on conflict."""
    document = F.regexp_extract(part(c, "PATH"), "^/spreadsheets/d/([A-Za-z0-9_-]+)", 1)
    fragment = F.regexp_extract_all(F.concat(F.lit("&"), F.coalesce(part(c, "REF"), F.lit(""))), F.lit("&gid=([^&]*)"), F.lit(1))
    tabs = F.array_distinct(F.concat(query_values(c, "gid"), fragment))
    good = (F.size(tabs) <= 1) & ~F.exists(tabs, lambda t: ~t.rlike("^[0-9]+$"))
    tab = F.coalesce(F.get(tabs, F.lit(0)), F.lit("0"))
    return F.when((destination(c, sheet_host=sheet_host) == "sheet") & good, F.concat(F.lit(f"https://{sheet_host}/spreadsheets/d/"), document, F.lit("/export?format=csv&gid="), tab))


def query_id(href: Column, path_end: str, name: str) -> Column:
    """The positive id that one parameter names under a path, else null."""
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    found = F.regexp_extract_all(F.concat(F.lit("&"), F.regexp_extract(href, r"\?([^#]*)", 1)), F.lit(f"&{name}=([^&]*)"), F.lit(1))
    value = F.when(F.get(found, F.lit(0)).rlike("^[0-9]+$"), F.get(found, F.lit(0)).try_cast("bigint"))
    return F.when(F.endswith(F.rtrim(path), F.lit(path_end)) & (F.size(found) == 1) & (value > 0), value)


def preview_base(cover: Column, host: str, root: str, name: str = "pac_s.jpg", folder: str = "sample") -> Column:
    """The folder of preview images beside a cover ``https://host/root/.../name``; null for any other address."""
    pattern = rf"(?i)^https://{host.replace('.', '[.]')}/({root}(?:/[A-Za-z0-9_-]+)+)/{name.replace('.', '[.]')}$"
    directory = F.regexp_extract(F.trim(cover), pattern, 1)
    return F.when(directory != "", F.concat(F.lit(f"https://{host}/"), directory, F.lit(f"/{folder}/")))


def is_preview_base(c: Column, host: str, root: str, folder: str = "sample") -> Column:
    return F.coalesce(F.trim(c).rlike(rf"(?i)^https://{host.replace('.', '[.]')}/{root}(/[A-Za-z0-9_-]+)+/{folder}/$"), F.lit(False))


def preview_urls(base: Column, count: Column, start: int = 1, limit: int = 4, most: int = 6) -> Column:
    """Addresses of images ``start`` to ``start + limit - 1`` (at most ``most``), as far as ``count`` reaches."""
    last = F.least(count, F.lit(start + min(limit, most) - 1))
    numbers = F.when((last >= start) & base.isNotNull(), F.sequence(F.lit(start), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.concat(base, F.lpad(i.cast("string"), 3, "0"), F.lit("_l.jpg")))


def pick_cover(candidates: Column, code: Column) -> Column:
    """The first candidate whose path has the record's prefix as a part, else the first."""
    prefix = F.lower(F.regexp_extract(code, "^(.*)-[^-]*$", 1))
    own = F.filter(candidates, lambda u: F.array_contains(F.split(F.lower(F.regexp_replace(u, r"^https?://[^/]*", "")), "/"), prefix))
    return F.coalesce(F.get(own, F.lit(0)), F.get(candidates, F.lit(0)))


def eligible_cover(cover: Column, host: str, root: str) -> Column:
    return F.coalesce((part(cover, "PROTOCOL") == "https") & (part(cover, "HOST") == host) & F.startswith(part(cover, "PATH"), F.lit(f"/{root}/")), F.lit(False))


def normalize_color(c: Column) -> Column:
    """``#rrggbb`` from ``#rgb``, ``#rrggbb`` or ``rgb(r, g, b)`` with parts up to 255, else null."""
    low = F.lower(F.trim(c))
    parts = [F.regexp_extract(low, r"^rgb\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*\)$", i).try_cast("int") for i in (1, 2, 3)]
    in_range = (parts[0] <= 255) & (parts[1] <= 255) & (parts[2] <= 255)
    hexes = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(p)), 2, "0") for p in parts])
    short = F.regexp_replace(low, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(low.rlike("^#[0-9a-f]{6}$"), low).when(low.rlike("^#[0-9a-f]{3}$"), short).when(in_range, hexes)
