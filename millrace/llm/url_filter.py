"""URL filters by a bit-parallel wildcard automaton.

All rules are packed, one bit a position, into a row of 64-bit words. Each byte of a batch of URLs moves
every pattern of every URL on at once: shift, or in the starts, mask by the byte. ``*`` stays within the
host (it stands for bytes other than ``/``), ``**`` stands for anything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text, unused

#: Bytes of automaton states at once.
STATES = 16 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``text`` is host plus path start, such as ``example.com/en/``; it fits the host and its subdomains."""

    text: str
    verdict: str


class GlobAutomaton:
    """Shift-And over several globs at once."""

    def __init__(self, globs: list[str]):
        steps: list[tuple[int, int, int]] = []  # of each bit: its byte, or -1; may it repeat on host bytes, on all
        starts, ends = [], []
        for g in globs:
            raw = g.encode()
            starts.append(len(steps))
            steps.append((-1, 0, 0))  # the state before the first byte
            i = 0
            while i < len(raw):
                if raw[i] == 0x2A:
                    wide = raw[i : i + 2] == b"**"
                    byte, host, anything = steps[-1]
                    steps[-1] = (byte, 1, anything or int(wide))
                    i += 1 + wide
                else:
                    steps.append((raw[i], 0, 0))
                    i += 1
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.start = self._mask(starts)
        self.ends = ends
        self.take = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for b in range(256):
            self.take[b] = self._mask([k for k, s in enumerate(steps) if s[0] == b])
            self.stay[b] = self._mask([k for k, s in enumerate(steps) if s[2] or (s[1] and b != 0x2F)])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in bits:
            out[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        return out

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob: does it match the whole URL?"""
        n = len(urls)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[order] if n else np.zeros(0, np.int64)
        live = np.searchsorted(-size[order], -np.arange(1, (size.max() if n else 0) + 1), "right")
        state = np.repeat(self.start[None], n, 0)
        for at, k in enumerate(live):  # the longest come first: those that have a byte ``at`` are a prefix
            c = flat[first[:k] + at]
            s = state[:k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.take[c]) | (s & self.stay[c])
        hit = np.zeros((n, len(self.ends)), bool)
        for g, k in enumerate(self.ends):
            hit[order, g] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
        return hit


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Append host, path, rule and verdict; the longest fitting rule wins, ``default`` holds where none fits.

    The canonical URL is host plus path. Input columns named like an output (in any case) are replaced by it,
    all others stay; null URLs have an empty host and path and get the default. Of fitting rules of equal
    length the first one given wins. Whole URLs are matched, however long; repeated rows each get their
    verdict; an empty table gives no rows; without rules every URL gets the default.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    globs = [g for r in ranked for g in (f"{r.text}**", f"*.{r.text}**")]
    auto = GlobAutomaton(globs)

    #: URLs at once, so that the states of all rules take some STATES bytes at most.
    at_once = max(1, STATES // (8 * auto.words))

    def make(urls):
        parts = [auto.match([(u or "").encode() for u in urls[i : i + at_once]]) for i in range(0, len(urls), at_once)]
        hit = np.concatenate(parts) if parts else np.zeros((0, len(globs)), bool)
        fits = hit[:, 0::2] | hit[:, 1::2] if ranked else np.zeros((len(urls), 1), bool)
        best = [ranked[k] if any_ else None for k, any_ in zip(fits.argmax(1), fits.any(1), strict=True)]
        return [[r and r.text for r in best], [r.verdict if r else default for r in best]]

    ours = {"host", "path", "rule", "verdict"}
    canonical = unused(pages, "canonical")
    host, path = split_url(F.col(f"`{url}`"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ours]
    split = pages.select(*kept, host.alias("host"), path.alias("path"), F.concat(host, path).alias(canonical))
    return per_text(split, canonical, "rule string, verdict string", make, 1 << 20).drop(canonical)


#: Fixed values of the query.
RULES = [
    Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"), Rule("org/es/", "block"),
]


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT s.*, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN rh IS NULL THEN 0 ELSE length(rh || rp) END DESC) AS k
  FROM s LEFT JOIN r ON (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
