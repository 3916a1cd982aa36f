"""Regular expressions and literal tables shared by the Spark code and the
DuckDB oracle.

Every pattern here is valid, and means the same, in Java regex (Spark) and
RE2 (DuckDB): no ``\\s`` / ``\\w`` (their members differ between the two
engines), explicit code-point classes instead.
"""

from html.entities import html5

# Characters Python's str.isspace() accepts: ASCII controls \t..\r,
# the file/group/record/unit separators \x1c-\x1f, NEL and Unicode Z*.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}]"
WS_RUN = WS_CLASS + "+"
# Leading or trailing whitespace, for a Python-style strip().
WS_EDGES = "^" + WS_RUN + "|" + WS_RUN + "$"

# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# Token pieces: the public cl100k pre-tokeniser split with an explicit ASCII
# blank class.  Counting the pieces gives a lower bound on BPE tokens.
TOKEN_PIECES = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^ \t\n\x0b\x0c\r\p{L}\p{N}]+[\r\n]*"
)

# Markup removed before entity decoding: comments, doctype, script and style
# elements (to the end of the page if they aren't closed), tags with quoted
# attributes, and tags whose quotes don't pair up.  The possessive quantifiers
# keep a tag with thousands of attributes off the regex engine's stack.
HTML_MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|<!doctype[^>]*+>|<script\b[^>]*+>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*+>.*?(?:</style\s*>|\z)"
    r"|</?[a-z][^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+>|</?[a-z][^<>]*+>"
)
# The same for RE2, which has no possessive quantifiers and needs none.
HTML_MARKUP_RE2 = HTML_MARKUP.replace("*+", "*")

# A character reference without its ``&``; group 1 is the name or number.
HTML_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Named references and their text: the HTML standard's set, from Python's own table.
HTML_NAMES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
# Numbers 128 to 159 stand for the windows-1252 characters there.
HTML_NUMBERS = {str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}

# Sentence pieces for the rule-based splitter.
SENTENCE = r"[^.!?]+[.!?]*"

# Wiki-style section headings, one per line.
HEADING = r"==+ .* ==+"

# Lower-cased word terms for lexical scoring and feature hashing.
TERM_SPLIT = r"[^\p{L}\p{N}]+"

# Scheme://authority prefix; group 1 is urlparse's netloc.
URL_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
# Group 1 is the path with last-segment params (query, fragment excluded).
URL_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

# Fixed value: advertisement link predicate.
AD_LINK = r"(?i)^https?://(www\.)?google\..*/aclk\?.*$"

# Image file extensions routed to the image decoder.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff"]

# Section headings whose sections (and sub-sections) are
# discarded; 19 entries with "Footnotes" listed twice.
DISCARD_SECTIONS = [
    "See also",
    "References",
    "External links",
    "Further reading",
    "Footnotes",
    "Bibliography",
    "Sources",
    "Citations",
    "Literature",
    "Footnotes",
    "Notes and references",
    "Photo gallery",
    "Works cited",
    "Photos",
    "Gallery",
    "Notes",
    "References and sources",
    "References and notes",
    "ISBN",
]
