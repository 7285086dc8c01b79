"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose links are kept.
USEFUL_DOMAINS = [
    "calendar.google.com",
    "docs.google.com",
    "drive.google.com",
    "meet.google.com",
    "teams.microsoft.com",
    "zoom.us",
    "www.zoom.us",
    "forms.gle",
    "notion.so",
    "www.notion.so",
]
# Parts of a path that make a link worth keeping.
USEFUL_PATHS = [
    "/meet/",
    "/document/",
    "/spreadsheets/",
    "/presentation/",
    "/file/",
    "/calendar/",
    "/j/",
    "/wc/",
    "/join",
    "/invitation",
    "/event",
]
# Patterns that start a signature or a disclaimer, in the order they apply.
SIGNATURE_MARKERS = [
    r"--\s*\n",
    r"Sent from my iPhone",
    r"Sent from my Android",
    r"Get Outlook for",
    r"This email and any attachments",
    r"CONFIDENTIALITY NOTICE",
    r"This message contains confidential",
    r"For your security and privacy, please do not reply to this email",
    r"To stop receiving account service communications by email",
    r"Fidelity Brokerage Services LLC",
    r"EMAIL REF#",
    r"All rights reserved",
]
# Tags that give HTML away.
HTML_TAGS = "html|head|body|div|table|tr|td|style|script|meta|a|p|br|span|sup|sub|img|ul|ol|li|strong|em|blockquote"
# Display names of file types.
MIME_NAMES = {
    "application/vnd.google-apps.document": "Google Doc",
    "application/vnd.google-apps.spreadsheet": "Google Sheet",
    "application/vnd.google-apps.presentation": "Google Slides",
    "application/vnd.google-apps.folder": "Folder",
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Word Doc",
}

URL = r"^https?://([^/\s<>)\]]+)(/[^\s<>)\]]*)?"
URL_IN_TEXT = r"https?://[^\s<>)\]]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
EDGE_SPACE = r"^[\s\p{Z}\x1C-\x1F\x{85}]+|[\s\p{Z}\x1C-\x1F\x{85}]+$"
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
LONGEST_PATH = 32


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def first_present(*cs: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def word_count(c: Column) -> Column:
    """Runs of characters that are not white space; Unicode spaces separate too (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\s\p{Z}\x1C-\x1F\x{85}]+")), F.lit(0))


def is_substantive(c: Column, least: int = 4) -> Column:
    return word_count(c) >= least


def not_blank(c: Column) -> Column:
    """Not null and more than spaces; a lone tab is text."""
    return c.isNotNull() & (F.trim(c) != "")


def clean_lines(c: Column) -> Column:
    """Lines with inner runs of blanks made one space, ends stripped, empty ones dropped, joined by newline."""
    lines = F.transform(F.split(c, LINE_BREAK), lambda x: strip(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_message(c: Column) -> Column:
    """Message text: hard spaces become spaces, zero-width characters go, lines are cleaned (null: empty)."""
    text = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")), ZERO_WIDTH, "")
    return clean_lines(text)


def collapse_lines(c: Column) -> Column:
    """Lines without blank ones and without those that equal the line kept just before."""
    lines = F.filter(F.split(clean_lines(c), "\n"), lambda x: x != "")
    # Held in an array of its own, the lines are cleaned once and not again for each line.
    kept = F.transform(F.array(lines), lambda held: F.filter(held, lambda x, i: (i == 0) | (x != F.try_element_at(held, i))))[0]
    return F.array_join(kept, "\n")


def url_domain(url: Column) -> Column:
    return F.regexp_extract(url, URL, 1)


def compact_url(url: Column) -> Column:
    """Host and path if the path (query included, no slashes at its end) is short, else the host; other text as it is."""
    path = F.rtrim(F.regexp_extract(url, URL, 2), F.lit("/"))
    short = (path != "") & (F.length(path) <= LONGEST_PATH)
    return F.when(url_domain(url) == "", url).when(short, F.concat(url_domain(url), path)).otherwise(url_domain(url))


def is_useful_url(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, URL, 2))
    hint = F.lit(False)
    for part in USEFUL_PATHS:
        hint = hint | F.contains(path, F.lit(part))
    return (url_domain(url) != "") & (F.lower(url_domain(url)).isin(USEFUL_DOMAINS) | hint)


def normalize_url(url: Column) -> Column:
    return F.when(is_useful_url(url), compact_url(url)).otherwise("")


def rewrite_urls(text: Column) -> Column:
    """Text with every URL replaced by its compact form, or by nothing if it is of no use."""
    between = F.split(text, URL_IN_TEXT, -1)
    urls = F.transform(F.regexp_extract_all(text, F.lit(URL_IN_TEXT), F.lit(0)), normalize_url)
    return F.array_join(F.zip_with(between, urls, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def looks_like_html(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(rf"(?i)</?\s*(?:{HTML_TAGS})\b")), F.lit(False))


def cut_signature(c: Column) -> Column:
    """Text before the first signature or disclaimer marker; markers apply one after the other."""
    for marker in SIGNATURE_MARKERS:
        c = F.regexp_replace(c, f"(?is){marker}.*", "")
    return strip(c)


def cut_quote(c: Column) -> Column:
    """Text before a quoted reply."""
    return F.regexp_replace(c, r"(?s)On.+?wrote:.*", "")


def decode_base64url(c: Column) -> Column:
    """Text of base64url data; null where it is no such data, so a broken body doesn't end a job, and bytes that are no UTF-8 are marked."""
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def encode_base64url(c: Column) -> Column:
    return F.translate(F.base64(F.encode(c, "utf-8")), "+/\r\n", "-_")


def contact_keys(handle: Column) -> Column:
    """Keys under which a phone number or address is looked up, the more exact first."""
    h = strip(F.coalesce(handle, F.lit("")))
    digits = F.regexp_replace(h, r"\D", "")
    phone = F.concat(F.lit("phone:"), digits)
    return (
        F.when(F.contains(h, F.lit("@")), F.array(F.concat(F.lit("email:"), F.lower(h))))
        .when(digits == "", F.array().cast("array<string>"))
        .when(F.length(digits) >= 10, F.array(phone, F.concat(F.lit("phone:"), F.right(digits, F.lit(10)))))
        .otherwise(F.array(phone))
    )


def contact_name(full: Column, first: Column, last: Column, organization: Column) -> Column:
    """Full name, else first and last, else organization; null if none is there."""
    return first_present(full, F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))), organization)


def chat_label(display_name: Column, participants: Column, identifier: Column, chat_id: Column) -> Column:
    return first_present(display_name, F.array_join(participants, ", "), identifier, F.concat(F.lit("Chat "), chat_id.cast("string")))


def shorten(c: Column, n: int = 50) -> Column:
    """First code points and an ellipsis, which is there however short the text is."""
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def header_map(headers: Column) -> Column:
    """Header list (name, value) as a map; the last of a repeated name wins."""
    names = F.transform(headers, lambda h: h["name"])
    last = F.filter(headers, lambda h, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), h["name"]))
    return F.map_from_entries(F.transform(last, lambda h: F.struct(h["name"], h["value"])))


def mime_name(c: Column) -> Column:
    """Display name of a file type; unknown types as they are."""
    table = F.create_map(*[F.lit(x) for kv in MIME_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def apple_timestamp(ns: Column) -> Column:
    """Timestamp of nanoseconds since 2001-01-01 UTC."""
    return F.timestamp_micros(F.lit(978_307_200_000_000) + F.round(ns / 1000).cast("long"))


def message_date(ts: Column, zone: str = "US/Eastern") -> Column:
    """Local minute of a timestamp as text; the session's zone must be UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd hh:mm a")


def parse_message_date(c: Column) -> Column:
    return F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd hh:mm a"))


def event_time(date: Column, timestamp: Column, zone: str = "US/Eastern") -> Column:
    """Readable time of an event from its day or its ISO timestamp; a timestamp without offset is local."""
    local = F.when(
        F.rlike(timestamp, F.lit(r"(Z|[+-]\d\d:?\d\d)$")), F.from_utc_timestamp(F.try_to_timestamp(timestamp), zone)
    ).otherwise(F.try_to_timestamp(timestamp))
    shown = F.date_format(local, "EEEE, MMMM dd, yyyy 'at' hh:mm a 'ET'")
    return F.when(date.isNotNull(), F.concat(F.lit("All day on "), date)).otherwise(F.coalesce(shown, F.lit("Unknown time")))
