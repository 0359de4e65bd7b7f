"""Secrets in texts.

Three fixed patterns give the plain spans. Beyond those, strings near sensitive words are measured by what they
add to a zstandard frame whose dictionary holds identifiers and the text around them: names and words from the
surroundings cost a few bytes, a random string costs nearly its length, and such strings are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsrisk.llm.common import by_bytes, kept, ship

# The plain patterns, the group that counts, and its least length.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Texts without any of these, in lower case, have no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

# Words that make a context sensitive.
SENSITIVE = (
    "access", "apikey", "auth", "bearer", "cert", "cookie", "credential", "jwt", "license", "passphrase", "password",
    "private", "pwd", "salt", "secret", "session", "sign", "token",
)
SENSITIVE_WORD = re.compile(
    "(?ai:" + "|".join(SENSITIVE) + r"|(?<![a-z])key|key(?=s?[\"']?[\x20\t]*[:=]))|(?<=[a-z0-9])Key(?![a-z])", re.A
)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z0-9+/_=~-][A-Za-z0-9+/_=.~-]*")
# Symbols of passwords. A run with one of them is measured as a whole before its parts are.
SYMBOLS = "!@#$%^&*"
RUN = re.compile(r"[^\s\"'`<>()\[\]{},;|\\]{12,}+")
#: One symbol repeated at an end is a mark and no part of the run.
MARKS = re.compile(r"\A([!@#$%^&*])\1+|([!@#$%^&*])\2+\Z")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*[=:](?!//)")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|[^@]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z")
#: What stands between a word for a password and its value, which is measured even if it reads as words.
PASS = re.compile(r"(?ai:passphrase|password|passwd|pwd)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?\Z")
#: A string stands in the line of a sensitive word, the two lines before, the two after, or the lines up to so far after it.
REACH, LINES = 32, 2
#: It has so many characters at least; those below LEAST_PLAIN need letters, and digits unless they follow = or : or
#: have at most RARE_PAIRS of the letter pairs of plain words.
LEAST_NOVEL, LEAST_PLAIN, RARE_PAIRS = 12, 16, 0.2
#: The head of a private key, its end, and lines of key text where the end is missing.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
PEM_LINES = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{12,}+)++")
# The letter pairs that make up most of plain words, and their shares from which strings read as words.
PAIRS = frozenset(
    "ac ad ag al am an ar as at be bl ca ce ch ci co ct de di ea ec ed ee el em en er es et ge ha he hi ho ic ie il in io "
    "ir is it la le li ll lo ma me mo na nc nd ne ng ni no ns nt ol om on op or os ot ou pe ph po pr ra re ri ro rs rt sa "
    "se si so ss st su ta te th ti to tr ty ul un ur us ut ve vi".split()
)
LEAST_PAIRS, LEAST_PAIRS_WITH_DIGITS = 0.4, 0.6
#: Characters around a string that join the dictionary.
SURROUNDINGS = 512
#: Marginal compressed bytes per byte from which a string counts as novel.
NOVELTY = 0.8
#: Bytes measured at a time: from 64 on, zstandard codes literals by their frequency and any small alphabet looks cheap.
PIECE = 48
# Identifiers and phrases that are no secrets.
IDENTIFIERS = " ".join(
    (
        "access_token api_key apikey application/json authorization basic bearer certificate class client_id",
        "client_secret config configuration const content-type cookie credentials database default def echo encoding",
        "environment error export false function getElementById getenv github header hostname http https import include",
        "index install int interface json key license localhost login module name namespace null object os.environ",
        "package parameter password path placeholder port private process.env public refresh_token request response",
        "return secret self server session signature static string test token true undefined update url user username",
        "utf-8 value var version void your_api_key_here changeme example xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx",
        "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789",
    )
).encode()

SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each plain pattern that are long enough; a short match is passed over whole."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to frames primed with identifiers, surroundings and what precedes, per byte.

    It is measured in pieces whose literals are stored as they are, so neither a small alphabet nor length lowers
    the cost of a random string.
    """
    raw, known, added = candidate.encode(), IDENTIFIERS + b" " + around.encode("utf-8", "replace"), 0
    for at in range(0, len(raw), PIECE):
        before = raw[max(0, at - SURROUNDINGS) : at]
        primed = zstandard.ZstdCompressionDict(known + before, zstandard.DICT_TYPE_RAWCONTENT)
        frame = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
        added += len(frame.compress(raw[at : at + PIECE])) - len(frame.compress(b""))
    return added / len(raw)


def _pairs(value: str) -> tuple[int, int]:
    """Pairs of letters in a string, and those of them that plain words have."""
    low = value.lower()
    pairs = [low[k : k + 2] for k in range(len(low) - 1) if low[k : k + 2].isalpha()]
    return len(pairs), sum(p in PAIRS or not p.isascii() for p in pairs)


def reads_as_words(value: str) -> bool:
    """Whether a string is a compound of letters only, or has mostly the letter pairs of plain words."""
    low, parts = value.lower(), re.split("[-_./]", value)
    digits = any(c.isdigit() for c in value)
    if not digits and len(parts) > 1 and max(map(len, parts)) < LEAST_PLAIN:
        return True
    pairs, plain = _pairs(value)
    least = LEAST_PAIRS_WITH_DIGITS if digits and (len(parts) == 1 or low != value) else LEAST_PAIRS
    return 2 * pairs >= len(value) - len(parts) and plain >= least * pairs


def _marked_words(value: str) -> bool:
    """Whether a string with symbols is words, numbers and marks around or between them."""
    parts = [p for p in re.split(r"[\W_]+", value) if p]
    kinds = sum(len(set(p)) > 1 and any(c.isalpha() for c in p) and any(c.isdigit() for c in p) for p in parts)
    pairs, plain = _pairs(value)
    letters = sum(c.isalpha() for c in value)
    if not kinds and (not letters or 2 * pairs >= letters) and plain >= LEAST_PAIRS * pairs and len(parts) <= max(1, len(value) // 5):
        return True
    return reads_as_words(value)


def key_blocks(text: str) -> list[tuple[str, int, int]]:
    """The text of each private key, from its BEGIN line to its END line, or as far as its lines go."""
    found, at = [], 0
    none: set[str] = set()  # labels without an end from here on
    while head := PEM.search(text, at):
        at = head.end()
        end = -1 if head[1] in none else text.find(f"-----END {head[1]}-----", at)
        if end < 0:
            none.add(head[1])
            lines = PEM_LINES.match(text, at)
            end = lines.end() if lines else at
        body = text[at:end]
        longest = max(TOKEN.findall(body), key=len, default="")
        if len(longest) >= LEAST_NOVEL and not reads_as_words(longest):
            start = at + len(body) - len(body.lstrip())
            found.append(("novel", start, at + len(body.rstrip())))
            at = end
    return found


def near_lines(text: str) -> Iterator[tuple[int, int]]:
    """Places of the lines with a sensitive word and of those next to them; no place comes twice."""
    at = done = 0
    while word := SENSITIVE_WORD.search(text, at):
        start = text.rfind("\n", done, word.start()) + 1 or done
        for _ in range(LINES):
            start = (text.rfind("\n", done, start - 1) + 1 or done) if start > done else done
        end = after = text.find("\n", word.end())
        for step in range(LINES):
            after = text.find("\n", after + (REACH if not step else 1)) if after >= 0 else -1
        yield start, len(text) if after < 0 else after
        if end < 0:
            return
        at, done = end, len(text) if after < 0 else after


def _candidates(text: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Runs with symbols, then strings of plain characters, that can be secrets."""
    for run in RUN.finditer(text, first, last):
        start, end = run.span()
        if name := NAME.match(text, start, end):
            start = name.end()
        end -= len(text[start:end]) - len(text[start:end].rstrip(".:?!"))
        value = text[start:end]
        marked = any(c in MARKS.sub("", value) for c in SYMBOLS)
        if len(value) >= LEAST_NOVEL and marked and not ADDRESS.match(value) and not _marked_words(value):
            yield start, end
    for whole in TOKEN.finditer(text, first, last):
        # Of name=value the value counts; what ends in = is padding.
        start, end = whole.start() + whole[0].rstrip("=").rfind("=") + 1, whole.end()
        value = text[start:end]
        if len(value) < LEAST_NOVEL:
            continue
        if reads_as_words(value):
            if PASS.search(text, max(0, start - SURROUNDINGS), start):
                yield start, end
            continue
        letters, digits = sum(c.isalpha() for c in value), any(c.isdigit() for c in value)
        bound = text[max(0, start - 4) : start].rstrip(" \"'")[-1:] in ("=", ":")
        pairs, plain = _pairs(value)
        if len(value) >= LEAST_PLAIN or (letters >= 4 and (digits or bound or plain <= RARE_PAIRS * pairs)):
            yield start, end


def novel_spans(text: str, taken: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Private keys, and novel strings near sensitive words, that no span in `taken` covers."""
    low = text.lower()
    if not any(word in low for word in (*SENSITIVE, "key")):
        return []
    found = key_blocks(text)
    covers = sorted((a, b) for _, a, b in [*taken, *found])
    starts, ends = [a for a, _ in covers], list(accumulate((b for _, b in covers), max))
    for first, last in near_lines(text):
        runs: list[tuple[int, int]] = []  # novel runs with symbols, in order; their parts are not measured again
        for start, end in _candidates(text, first, last):
            at, own = bisect_right(starts, start), bisect_right(runs, (start, len(text)))
            if (at and ends[at - 1] >= end) or (own and runs[own - 1][1] >= end):
                continue
            around = text[max(0, start - SURROUNDINGS) : start] + text[end : end + SURROUNDINGS]
            if novelty(text[start:end], around) >= NOVELTY:
                found.append(("novel", start, end))
                runs.append((start, end))
    return sorted(found)


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Plain and novel spans by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    order = (*BASE_KINDS, "novel")
    return sorted(base + novel_spans(text, base), key=lambda s: (s[1], order.index(s[0])))


def find_secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then `spans`: kind, start and end (exclusive) in code points, by start and kind.

    Only `text` is searched, in whole. A null or empty text has no spans;
    repeated rows give repeated rows, an empty table an empty result, and other
    columns play no part.
    """
    ship(docs)
    inward, names, fields, outward = kept(docs, keep)
    rows = docs.select(*inward, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t)] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(spans, _ARROW)], names=[*names, "spans"])

    schema = T.StructType([*fields, *T.StructType.fromDDL(f"spans {SPANS}")])
    return rows.mapInArrow(run, schema).select(*outward, "spans")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of `text` replaced by `mark`, and `n_chars`, if there, counted again.

    Rows without spans stay as they are. Overlapping spans are replaced as one.
    """
    ship(docs)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        spans = all_spans(text)
        if not spans:
            return text
        out, at = [], 0
        for _, start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            cleaned = [clean(t) for t in texts]
            changed = [a != b for a, b in zip(texts, cleaned)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(cleaned, batch.schema.field(at).type))
            if "n_chars" in names:
                at = batch.schema.get_field_index("n_chars")
                counts = [len(t) if c else n for t, c, n in zip(cleaned, changed, batch.column(at).to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
