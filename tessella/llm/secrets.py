"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums (operator 7).

Texts are scanned as UTF-8 bytes shown one character a byte, so that lower-casing touches A-Z alone and places
stay aligned. The automaton finds keywords; a pattern is only tried where its keyword was found. Bare hex runs
have no keyword: every run of 16 covers a place that is a multiple of 16, so only those places are probed and
the run around a hit is matched. Places become code points for matches only.

Token kinds with an embedded checksum (CRC-32 of the body in base 62, six digits) are reported only if it holds.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table

# Base kinds in order, their patterns and least lengths; prefixes of tokens that embed a CRC-32.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(ghp_|gho_|ghu_|ghs_|ghr_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_RUN = re.compile(rb"[0-9a-f]+")
_LAST = re.compile(rb"[0-9a-f]*\Z")
_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        words = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
        words |= {"akia": "access"} | dict.fromkeys(CHECKED_PREFIXES, "checked")
        for word, kind in words.items():
            made.add_word(word, (kind, len(word)))
        made.make_automaton()
        _automaton = made
    return _automaton


def checksum_holds(body: str, check: str) -> bool:
    n, digits = zlib.crc32(body.encode("latin-1")), ""
    while n:
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.rjust(6, "0") == check


def hex_runs(data: bytes, least: int = LEAST["hex"]) -> list[tuple[int, int]]:
    """Maximal runs of ``[0-9a-f]`` with at least ``least`` bytes; only every ``least``-th byte is probed."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found, end = [], 0
    for at in (np.flatnonzero(_HEX[raw[least - 1 :: least]]) * least + least - 1).tolist():
        if at < end:
            continue
        # before a probe there are at most least - 1 bytes of the run: an earlier probe would have been in it
        start = _LAST.search(data, max(end, at - least + 1), at).start()
        end = _RUN.match(data, at).end()
        if end - start >= least:
            found.append((start, end))
    return found


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind."""
    text = data.decode("latin-1")
    spans, end_of = [], {"assign": 0, "access": 0, "checked": 0}
    hits = sorted({(at - n + 1, kind) for at, (kind, n) in automaton().iter(data.lower().decode("latin-1"))})
    for start, kind in hits:
        if start < end_of[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                end_of[kind] = m.end()
                if len(m[2]) >= LEAST[kind]:
                    spans.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                end_of[kind] = m.end()
                if m.end() - start >= LEAST[kind]:
                    spans.append((kind, start, m.end()))
        elif (m := CHECKED.match(text, start)) and checksum_holds(m[2], m[3]):
            end_of[kind] = m.end()
            spans.append((kind, start, m.end()))
    spans += [("hex", a, b) for a, b in hex_runs(data)]
    order = {k: i for i, k in enumerate((*KINDS, "checked"))}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def _in_code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or data.isascii():
        return spans
    heads = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    upto = lambda i: int(heads[i - 1]) if i else 0
    return [(k, upto(a), upto(b)) for k, a, b in spans]


def secret_spans():
    """A column function text -> array of struct(kind, start, end) in code points, end exclusive."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        out = []
        for text in texts.cast(pa.large_string()).cast(pa.large_binary()):
            data = text.as_py() or b""
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in _in_code_points(data, scan(data))])
        return pa.array(out, kind)

    return find


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` (array of kind, start, end), one row per input row; repeated rows and null ids are scanned alike,
    an empty table gives an empty result, other columns are ignored."""
    return df.select(F.col(id_col).alias("id"), secret_spans()(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    return found.select(
        F.col("id").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
