"""Column -> Column text expressions.  All run inside the JVM (no Python UDF),
most inside whole-stage codegen; the array forms use higher-order functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), P.WS_EDGES, "")


def strip_chars(col, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.btrim(_c(col), F.lit(chars))


def words(col) -> Column:
    """Python ``str.split()``: whitespace-separated words, no empty strings."""
    return F.filter(F.split(_c(col), P.WS_RUN), lambda w: w != "")


def lines(col) -> Column:
    """Python ``str.splitlines()`` (a trailing empty piece may remain)."""
    return F.split(_c(col), P.LINE_BREAK)


def terms(col) -> Column:
    """Lower-cased letter/number runs, used for hashing and lexical scoring."""
    return F.filter(F.split(F.lower(_c(col)), P.TERM_SPLIT), lambda w: w != "")


def token_count(col) -> Column:
    """Token count (T1): number of pre-tokeniser pieces, as BIGINT."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(P.TOKEN_PIECES)), F.lit(0)).cast("bigint")


def _constant_map(entries: dict[str, str]) -> Column:
    """A map literal (folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point; U+FFFD for what isn't one."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    raw = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0"))
    return F.decode(raw, "UTF-32")


def decode_references(col) -> Column:
    """HTML character references as characters, in one pass: the standard names
    and decimal or hexadecimal numbers, closed by ``;``.  Others stay as written."""
    pieces = F.split(_c(col), "&")
    names, numbers = _constant_map(P.HTML_NAMES), _constant_map(P.HTML_NUMBERS)

    def decoded(piece, ref):
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2)))
        text = F.when(ref.startswith("#"), F.coalesce(F.try_element_at(numbers, F.ltrim(number, F.lit("0"))), _character(number.cast("long")))).otherwise(
            F.try_element_at(names, ref))
        return F.coalesce(F.concat(text, F.substr(piece, F.length(ref) + 2)), F.concat(F.lit("&"), piece))

    def each(piece, i):
        ref = F.regexp_extract(piece, P.HTML_REFERENCE, 1)
        return F.when(i == 0, piece).otherwise(F.element_at(F.transform(F.array(ref), lambda r: decoded(piece, r)), 1))

    return F.when(F.instr(_c(col), "&") > 0, F.array_join(F.transform(pieces, each), "")).otherwise(_c(col))


def html_to_text(col) -> Column:
    """Visible text of an HTML page (B1).

    Markup, comments, scripts and styles are removed with one left-to-right
    alternation (tags vanish without inserting a blank); character references
    are decoded once; each line is stripped, split on double blanks, stripped
    again; empty pieces dropped; pieces joined with newlines.
    """
    s = decode_references(F.regexp_replace(_c(col), P.HTML_MARKUP, ""))
    pieces = F.flatten(F.transform(lines(s), lambda ln: F.split(py_strip(ln), "  ")))
    kept = F.filter(F.transform(pieces, py_strip), lambda p: p != "")
    return F.array_join(kept, "\n")


def headings_as_lines(col) -> Column:
    """HTML headings of level 2 to 6 as wiki heading lines (``== x ==``), so that
    an encyclopedia page can be split into sections once its markup is gone."""
    s = _c(col)
    for level in range(2, 7):
        line = "=" * level
        s = F.regexp_replace(s, rf"(?is)<h{level}\b[^>]*+>(.*?)</h{level}\s*>", f"\n{line} $1 {line}\n")
    return s


def canonical_url(col) -> Column:
    """URL without ``;params`` of the last segment, ``?query`` and ``#fragment`` (B2).

    Dot segments are resolved only when ``/.`` occurs, by a fold over the
    path segments.  A host with one square bracket but not the other gives null.
    """
    base = F.regexp_replace(F.regexp_replace(_c(col), r"[?#].*$", ""), r";[^/]*$", "")
    prefix = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substr(base, F.length(prefix) + 1)
    segs = F.split(path, "/")
    resolved = F.aggregate(
        F.slice(segs, 2, F.size(segs)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segs, -1)
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    dotted = F.concat(prefix, F.lit("/"), F.array_join(resolved, "/"), tail)
    host = url_authority(col)
    odd = (F.instr(host, "[") > 0) != (F.instr(host, "]") > 0)
    return F.when(~odd, F.when(F.instr(path, "/.") > 0, dotted).otherwise(base))


def url_authority(col) -> Column:
    """``urlparse(url).netloc`` (user info and port included)."""
    return F.regexp_extract(_c(col), P.URL_AUTHORITY, 1)


def url_path(col) -> Column:
    """``urlparse(url).path``: ``;params`` of the last segment removed."""
    return F.regexp_replace(F.regexp_extract(_c(col), P.URL_PATH, 1), r";[^/]*$", "")


def is_wikipedia(col) -> Column:
    """Host contains ``wikipedia.org``."""
    return F.contains(url_authority(col), F.lit("wikipedia.org"))


def wiki_title(col) -> Column:
    """``/wiki/<seg>`` gives the percent-decoded segment with ``_`` as blank.

    ``+`` is protected before decoding because Python's ``unquote`` keeps it.
    Malformed escapes give null.
    """
    parts = F.split(url_path(col), "/")
    seg = F.try_element_at(parts, F.lit(3))
    decoded = F.try_url_decode(F.replace(seg, F.lit("+"), F.lit("%2B")))
    ok = (F.size(parts) > 2) & (F.try_element_at(parts, F.lit(2)) == "wiki")
    return F.when(ok, F.replace(decoded, F.lit("_"), F.lit(" ")))


def is_ad_link(col) -> Column:
    """Advertisement link predicate."""
    return _c(col).rlike(P.AD_LINK)


def file_extension(col) -> Column:
    """A2: text after the last dot, lower-cased (the whole name if no dot)."""
    return F.lower(F.element_at(F.split(_c(col), r"\."), -1))


def file_kind(col) -> Column:
    """A2 + B12: decoder family of a file name."""
    ext = file_extension(col)
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("doc", "docx"), "docx")
        .when(ext.isin("csv", "xlsx"), "table")
        .when(ext == "txt", "text")
        .when(ext.isin(*P.IMAGE_EXTENSIONS), "image")
        .otherwise("unsupported")
    )


def verdict(col) -> Column:
    """``yes`` anywhere -> true, else ``no`` anywhere -> false, else null."""
    low = F.lower(_c(col))
    return F.when(F.contains(low, F.lit("yes")), True).when(F.contains(low, F.lit("no")), False)


# Answer profiles in parse precedence order.
AGENT_NAMES = ["DocAgent", "TableAgent", "MathAgent", "LiteratureAgent", "ScienceAgent"]


def agent_name(col) -> Column:
    """First profile name contained in a router reply, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(AGENT_NAMES):
        out = F.when(F.contains(_c(col), F.lit(name)), F.lit(name)).otherwise(out)
    return out


# Console commands.
COMMANDS = ["exit", "smart tutor", "simple tutor", "add docs", "help"]


def command(col, mode: str = "exact") -> Column:
    """Classify an utterance as a command or ``question``.

    ``exact``: lower-cased equality (typed console); ``contains``: first
    command contained, in the order exit, smart, simple, add docs, help.
    """
    low = F.lower(_c(col))
    out = F.lit("question")
    for cmd in reversed(COMMANDS):
        hit = (low == cmd) if mode == "exact" else F.contains(low, F.lit(cmd))
        out = F.when(hit, F.lit(cmd)).otherwise(out)
    return out
