"""Secret scan: fixed patterns, and strings that a public vocabulary needs unusually many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

#: Fixed patterns of the base kinds; letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "dense")

#: A run long enough to be a key. It may start behind "=", as values do; "=" belongs to it only as padding at its end.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])")
#: At most this many characters a token: random strings have 1.1 to 1.9, words 2.5 and more.
MOST_CHARS_PER_TOKEN = 2.0
#: Lengths of common digests in hex: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: One part of an identifier, path or slug: words, each but the first with a capital, and a number behind them, or a number.
#: No alternative can match a string in two ways, so time is linear in its length.
_PART = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]*)[0-9]{0,4}|[0-9]+")

#: A word of a part: capitals, or letters with at most one capital, their first.
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def known(run: str, tokens: Callable[[str], int] | None = None, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Whether a run is a digest or an identifier: hex of a digest's length, a UUID, a number, or words and numbers that
    separators join. Shape alone makes no words, as random letters have it too: the words, in lower case and without
    what joins them, must have more than ``most`` characters a token (by default under ``encoder()``)."""
    if len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    if not any(c.isalpha() for c in run):
        return True
    if any(c.isdigit() for c in run) and not all(_PART.fullmatch(p) for p in re.split(r"[-_/+=]", run)):
        return False
    words = [w.lower() for w in _WORD.findall(run)]
    return sum(map(len, words)) > most * sum(map(tokens or encoder(), words))


@cache
def encoder(vocabulary: str | None = None) -> Callable[[str], int]:
    """Number of tokens of a string under a tiktoken rank file; by default the public 50k byte-level vocabulary. One for each
    Python worker and file, kept from task to task."""
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(own.encode_ordinary(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, ordered by start, then kind; offsets in code points."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def dense_spans(text: str, base: list[tuple[int, int, int]], tokens: Callable[[str], int], most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Further spans: runs of few characters a token that are neither known nor touch a base span."""
    found = []
    for m in RUN.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        if any(s < end and start < e for s, _, e in base):
            continue
        if len(run) <= most * tokens(run) and not known(run, tokens, most):
            found.append((start, 3, end))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """A row for each row of ``docs``: id, n_assign, n_access, n_hex (long), base_sha256, spans.

    ``spans`` has every span as kind:start:end in code points, by start, then kind; base_sha256 digests the base kinds
    alone. The scan is one pass without a shuffle over whole texts; memory is bounded by an Arrow batch. Null and empty
    texts have no spans, repeated rows give repeated rows, other columns are ignored.
    """

    def one(batch: pa.RecordBatch) -> dict:
        tokens = encoder(vocabulary)
        rows = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            extra = dense_spans(text, base, tokens, most) if text else []
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                rows[c].append(sum(s[1] == k for s in base))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            rows["spans"].append(_joined(sorted(base + extra)))
        return {id_col: batch.column(0), **rows}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
