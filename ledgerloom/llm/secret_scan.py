"""Operator 10: secrets, found by patterns and confirmed by structure.

Base kinds are patterns alone. Added kinds are reported only once a candidate has been decoded and
its inside parsed: DER keys whose nested lengths fill the candidate exactly (of PKCS #8, the key
within as well), OpenSSH private keys whose length fields add up, either of them in base64 or hex, on one
line or wrapped (indented, quoted and joined as in code, with line ends escaped, hex with colons),
PEM blocks around either, signed tokens whose header is a JSON object that names an algorithm and
whose claims are another, and base64 or hex that hides, at any place and alignment, a DER key, a PEM
block, an access id or base64 of one of them.

Every step takes time in proportion to the text, whatever it holds: lines are joined in one walk, a
run is decoded once for each alignment, a key is parsed only where its first length leads to the end
of what was decoded, and a PEM block ends where the next begins.

Spans are code points, end exclusive. A null or empty text has no spans. A base span is never
dropped; an added span may lie on it. Each row is scanned by itself: rows that repeat a doc_id have
each their own result. An empty table gives an empty result. Columns other than doc_id and text
aren't looked at by the scan, and kept by redaction.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, map_arrow, table

BASE = ("assign", "access", "hex")
ADDED = ("jwt", "der_key", "ssh_key", "pem_key", "encoded")
ORDER = {kind: k for k, kind in enumerate(BASE + ADDED)}

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 or more are just those runs of `[0-9a-f]+` that are long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Runs that have room for the shortest hidden access id, 18 bytes.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
HEX_KEY = re.compile(r"[0-9A-Fa-f]{36,}")
#: Signs of the alphabet also part names and paths, so what is encoded may begin behind any of them.
STARTS = re.compile(r"\A|(?<=[+/_-])")
#: Base64 of a DER sequence begins with M, of the OpenSSH magic with b3Bl.
KEY_STARTS = re.compile(r"(?<![A-Za-z0-9])(?=M|b3Bl)")
#: What may go on over lines: runs of digits, and what parts two of them. An operator before a line's run counts only with a quote.
RUN = re.compile(r"[A-Za-z0-9+/_:-]{20,}+={0,2}+")
MORE = re.compile(r"[A-Za-z0-9+/_:-]++={0,2}+")
JOIN = re.compile(r"""((?:\\++[rn])*+)["'`]?+[ \t]*+[,;+.&\\]?+[ \t]*+((?:\r?\n[ \t]*+)*+)(?:[+.&][ \t]*+(?=["'`]))?+["'`]?+""")
#: Digits of the shortest thing that lines hold together.
LEAST = 48
#: Sequences that begin with a version, as private keys do.
DER_START = re.compile(rb"\x30(?:\x81.|\x82..|[\x20-\x7f])\x02\x01[\x00-\x03]", re.S)
HIDDEN = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----|AKIA[A-Z0-9]{14,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
#: Base64 within what has been decoded, and how often that is followed.
INNER = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+")
DEEPEST = 3
#: Line ends as JSON and env files write them, escaped once or more.
ESCAPED_END = re.compile(r"(?<!\\)\\++[rn]")
QUOTED_END = re.compile(r"""["'`][ \t]*+[+.&,;\\]?+[ \t]*+\r?\n[ \t]*+[+.&]?+[ \t]*+["'`]?""")
SSH_MAGIC = b"openssh-key-v1\x00"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def der_items(raw: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of each value between start and end; None unless their lengths fill it exactly."""
    end, found = len(raw) if end is None else end, []
    while start < end:
        if end - start < 2:
            return None
        tag, size, start = raw[start], raw[start + 1], start + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(raw[start : start + n], "big"), start + n
            if size < 0x80:  # not the shortest form
                return None
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def der_end(raw: bytes, start: int) -> tuple[int, int]:
    """Where the contents of the value at start begin and end, by its length."""
    if start + 2 > len(raw):
        return start, len(raw) + 1
    n = raw[start + 1] & 0x7F if raw[start + 1] >= 0x80 else 0
    inside = start + 2 + n
    return inside, inside + (int.from_bytes(raw[start + 2 : inside], "big") if n else raw[start + 1])


def is_der_key(raw: bytes, start: int = 0, end: int | None = None) -> bool:
    """Whether raw from start to end is one private key: plain RSA, DSA or EC, PKCS #8, or encrypted PKCS #8."""
    end = len(raw) if end is None else end
    inside, leads_to = der_end(raw, start)
    if leads_to != end or raw[start] != 0x30:
        return False
    items = der_items(raw, inside, end)
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]
    value = lambda k: raw[items[k][1] : items[k][2]]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # algorithm, encrypted octets
        inner = der_items(raw, *items[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and len(value(1)) >= 16
    if tags[0] != 0x02 or len(value(0)) != 1 or value(0)[0] > 3:
        return False
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # version, algorithm, key octets
        inner = der_items(raw, *items[1][1:])
        key = der_items(raw, *items[2][1:])
        if not inner or inner[0][0] != 0x06 or not key or len(key) != 1:
            return False
        return key[0][0] in (0x02, 0x04) or key[0][0] == 0x30 and bool(der_items(raw, *key[0][1:]))  # integer, octets, or a sequence
    if tags[1] == 0x04:  # version, EC scalar
        return len(value(1)) >= 20
    return len(tags) >= 6 and set(tags[1:9]) == {0x02}  # version, then integers


def is_ssh_key(raw: bytes, start: int = 0) -> bool:
    """Whether raw from start on is an OpenSSH private key whose length fields lead exactly to its end."""
    if not raw.startswith(SSH_MAGIC, start):
        return False
    at, sizes = start + len(SSH_MAGIC), []
    for step in ("s", "s", "s", "n", "s", "s"):  # cipher, kdf, kdf options, count of keys, public, private
        if at + 4 > len(raw):
            return False
        size, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
        if step == "s":
            at += size
            sizes.append(size)
        elif size != 1:
            return False
    return at == len(raw) and min(sizes[0], sizes[-1]) > 0


def from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def whole_key(raw: bytes | None, start: int = 0) -> str | None:
    """Which key raw is from start to its end."""
    if not raw or start >= len(raw):
        return None
    if raw[start] == 0x30 and is_der_key(raw, start):
        return "der_key"
    return "ssh_key" if is_ssh_key(raw, start) else None


def hidden_at(raw: bytes | None, depth: int = 1) -> int | None:
    """Where in raw a PEM block, an access id, a DER key, or base64 that hides one of them, begins."""
    if not raw:
        return None
    found = [m.start()] if (b"AKIA" in raw or b"-----BEGIN " in raw) and (m := HIDDEN.search(raw)) else []
    for m in DER_START.finditer(raw):
        end = der_end(raw, m.start())[1]
        if end <= len(raw) and is_der_key(raw, m.start(), end):
            found.append(m.start())
            break
    if not found and depth < DEEPEST:
        found += [m.start() for m in INNER.finditer(raw) if base64_keys(m[0].decode(), depth + 1)][:1]
    return min(found, default=None)


def base64_keys(run: str, depth: int = 1) -> list[tuple[int, str]]:
    """(start, kind) of what a run of base64 hides.

    What stands before the encoded part may shift it, so the run is decoded at all four alignments.
    Where something hidden has no start of its alignment before it, the span is the whole run."""
    body, found = run.rstrip("="), []
    starts, keys = [m.start() for m in STARTS.finditer(body)], [m.start() for m in KEY_STARTS.finditer(body)]
    for k in range(4):
        odd = (len(body) - k) % 4 == 1  # a character that ends no byte
        raw = from_base64(body[k : len(body) - odd])
        whole = [] if odd else [(s, kind) for s in keys if s % 4 == k and (kind := whole_key(raw, (s - k) // 4 * 3))]
        found += whole
        if not whole and (at := hidden_at(raw, depth)) is not None:
            found.append((next((s for s in starts if s % 4 == k and (s - k) // 4 * 3 <= at), 0), "encoded"))
    return found


def hex_keys(run: str) -> list[tuple[int, str]]:
    """The same for a run of hex digits, of which one before or behind may be none of the encoded part's."""
    found = []
    for k in (0, 1):
        raw = bytes.fromhex(run[k : len(run) - (len(run) - k) % 2])
        if kind := whole_key(raw) or (hidden_at(raw) is not None and "encoded"):
            found.append((k, kind))
    return found


def joined_runs(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, runs) of runs that go on over lines of one width, of which the last may be shorter, and of single runs with colons.

    The first run may begin anywhere in its line. A run that ends one block may begin the next, so each is read twice at most."""
    found, done = [], 0
    for m in RUN.finditer(text):
        if m.start() < done:
            continue
        start, end, runs = m.start(), m.end(), [m[0]]
        while (gap := JOIN.match(text, end)) and (gap[1] or gap[2]) and (more := MORE.match(text, gap.end())):
            widths = [len(runs[1]), len(runs[-1])] if len(runs) > 1 else [len(more[0])]
            if len(more[0]) > widths[0] or widths[-1] != widths[0] or "=" in runs[-1]:
                break
            runs.append(more[0])
            end = more.end()
        if len(runs) > 1 or ":" in m[0]:
            found.append((start, end, runs))
        done = end - len(runs[-1]) if len(runs) > 2 else m.end()
    return found


def joined_key(runs: list[str]) -> tuple[int, str] | None:
    """(start, kind) of what runs hold together: hex, with colons or without, or base64."""
    digits = "".join(runs).replace(":", "")
    if len(digits) < LEAST:
        return None
    lead = runs[0].rfind(":", 0, 12) if not re.fullmatch(r"[0-9A-Fa-f:]+", runs[0]) else -1  # a name before the key
    if re.fullmatch(r"[0-9A-Fa-f]+", digits):
        if found := hex_keys(digits):
            return found[0]
    body = "".join(runs).rstrip("=")[lead + 1 :]
    if ":" in body or "=" in body:
        return None
    keys = [m.start() for m in KEY_STARTS.finditer(runs[0], lead + 1)]
    for k in range(4):
        odd = (len(body) - k) % 4 == 1
        raw = from_base64(body[k : len(body) - odd])
        for s in keys if not odd else ():
            if (s - lead - 1) % 4 == k and (kind := whole_key(raw, (s - lead - 1 - k) // 4 * 3)):
                return s, kind
        if hidden_at(raw) is not None:
            return lead + 1, "encoded"
    return None


def is_token_header(text: str) -> bool:
    raw = from_base64(text)
    try:
        head = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def is_token(m: re.Match) -> bool:
    """A header that names an algorithm, claims that are a JSON object, a signature that can be decoded."""
    if not is_token_header(m[1]) or from_base64(m[3]) is None:
        return False
    try:
        return isinstance(json.loads(from_base64(m[2]) or b""), dict)
    except (ValueError, RecursionError):
        return False


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Blocks that hold a key, from their BEGIN to the END of the same name before any other BEGIN."""
    found, begin = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            body = QUOTED_END.sub("\n", ESCAPED_END.sub("\n", text[begin.end() : m.start()]))
            body = re.sub(r"^[ \t]*+[A-Za-z-]++:.*$|[\s\"'`]", "", body, flags=re.M)
            if whole_key(from_base64(body)):
                found.append((begin.start(), m.end()))
            begin = None
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    low, found = text.lower(), []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return in_order(found)


def added_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    if "." in text and ("ey" in text or "ew" in text):
        found += [(m.start(), "jwt", m.end()) for m in TOKEN.finditer(text) if is_token(m)]
    for pattern, keys in ((BASE64, base64_keys), (HEX_KEY, hex_keys)):
        found += [(m.start() + k, kind, m.end()) for m in pattern.finditer(text) for k, kind in keys(m[0])]
    found += [(start + key[0], key[1], end) for start, end, runs in joined_runs(text) if (key := joined_key(runs))]
    blocks = pem_blocks(text) if "-----BEGIN " in text else []
    if blocks:  # what lies within a block is part of it; blocks don't overlap
        starts = [start for start, _ in blocks]
        within = lambda x: (at := bisect.bisect_right(starts, x[0]) - 1) >= 0 and x[2] <= blocks[at][1]
        found = [x for x in found if not within(x)] + [(start, "pem_key", end) for start, end in blocks]
    return in_order(found)


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], ORDER[s[1]], s[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str) -> str:
    """text with each span, or run of overlapping ones, replaced by the name of its first kind."""
    out, at, spans = [], 0, in_order(base_spans(text) + added_spans(text))
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, and all spans."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                kinds = [s[1] for s in base]
                rows.append((*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(in_order(base + added_spans(text)))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(id_and_text(docs), run, SCHEMA)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, with secrets in text redacted and n_chars, if there, renewed."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = map_arrow(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
