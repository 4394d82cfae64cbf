"""URL filters by a bit-parallel wildcard automaton.

Glob rules are compiled into one multiword Shift-And automaton: every rule
owns a run of adjacent bits, one for each literal already consumed, and a ``*``
is a self-loop on the bit before it. All rules advance together with a few
word operations for each byte of a URL, and all URLs of an Arrow batch advance
together as rows of a uint64 matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path) in the order given; a rule fits the host and its subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
#: URLs that advance together; bounds the state matrix to LANES x words x 8 bytes.
LANES = 4096


@dataclass(frozen=True)
class Automaton:
    """Masks of all rules, packed into words of 64 bits.

    ``step[b]`` holds the bits that byte b may move into, ``loop[b]`` those
    that may stay on b, ``final`` the last bit of each rule.
    """

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    finals: np.ndarray

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each rule: whether the rule's glob matches the whole URL."""
        out = np.zeros((len(urls), len(self.finals)), dtype=bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            out[lanes] = self._run([urls[i] for i in lanes])
        return out

    def _run(self, urls: list[bytes]) -> np.ndarray:
        sizes = np.array([len(u) for u in urls])  # longest first
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.frombuffer(b"".join(urls), dtype=np.uint8)
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(urls)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= t:
                live -= 1
            byte = flat[starts[:live] + t]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        word, bit = self.finals // 64, (self.finals % 64).astype(np.uint64)
        return (state[:, word] >> bit[None, :]) & one == one


def compile_globs(globs: Iterable[str]) -> Automaton:
    """``**`` stands for any text, ``*`` for any without a slash, ``?`` for one byte that is no slash; all else for itself."""
    parsed = []
    for glob in globs:
        literals: list[bytes | None] = []
        loops: dict[int, bool] = {}  # after how many literals, whether slashes too
        raw, i = glob.encode(), 0
        while i < len(raw):
            c = raw[i : i + 1]
            if raw[i : i + 2] == b"**":
                loops[len(literals)] = True
                i += 2
                continue
            if c == b"*":
                loops.setdefault(len(literals), False)
            else:
                literals.append(None if c == b"?" else c)
            i += 1
        parsed.append((literals, loops))
    bits = sum(len(x) + 1 for x, _ in parsed)
    width = max(1, -(-bits // 64))
    step, loop = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64)
    start, finals, base = np.zeros(width, np.uint64), [], 0
    mask = lambda p: (p // 64, np.uint64(1) << np.uint64(p % 64))
    for literals, loops in parsed:
        w, m = mask(base)
        start[w] |= m
        for k, c in enumerate(literals, 1):
            w, m = mask(base + k)
            allowed = [b for b in range(256) if b != 0x2F] if c is None else [c[0]]
            step[allowed, w] |= m
        for k, slashes in loops.items():
            w, m = mask(base + k)
            loop[[b for b in range(256) if slashes or b != 0x2F], w] |= m
        finals.append(base + len(literals))
        base += len(literals) + 1
    return Automaton(step, loop, start, np.array(finals, dtype=np.int64))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    host = rest[:end]
    return (host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)), path[:stop]


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """Add ``verdicts``: struct<host, path, rule, verdict> of every URL.

    A rule (verdict, host, path) becomes the glob ``**.host/path**`` over the
    canonical URL ``.host/path``; dots of the host part keep subdomains whole.
    The longest host + path wins, ties go to the earlier rule. A null URL, one
    without ``://`` and an empty one have an empty host and path, no rule, and
    the default verdict. Repeated rows are judged alike; other columns stay.
    """
    machine = compile_globs(f"*.{host}{path}**" for _, host, path in rules)
    names = [host + path for _, host, path in rules]
    rank = np.argsort(np.argsort([-len(n) for n in names], kind="stable"), kind="stable")
    best_first = np.argsort(rank)
    verdicts = [v for v, _, _ in rules]

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            parts = [split_url(None if pd.isna(u) else u) for u in urls]
            hits = machine.matches([f".{h}{p}".encode("utf-8", "surrogatepass") if h or p else b"" for h, p in parts])[:, best_first]
            chosen = np.where(hits.any(axis=1), best_first[hits.argmax(axis=1)], -1) if len(parts) else np.array([], int)
            yield pd.DataFrame(
                {
                    "host": [h for h, _ in parts],
                    "path": [p for _, p in parts],
                    "rule": [names[k] if k >= 0 else None for k in chosen],
                    "verdict": [verdicts[k] if k >= 0 else default for k in chosen],
                },
                columns=["host", "path", "rule", "verdict"],
            )

    return df.withColumn("verdicts", judged(F.col(url)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of all of pages; judge says how odd rows are taken."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "verdicts.host", "verdicts.path", "verdicts.rule", "verdicts.verdict")


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT c.page_id, c.host, c.path, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM cut) c JOIN rules r
    ON (c.host = r.rhost OR ends_with(c.host, '.' || r.rhost)) AND starts_with(c.path, r.rpath)
  GROUP BY ALL
)
SELECT c.page_id, coalesce(c.host, '') AS host, coalesce(c.path, '') AS path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fits f ON c.page_id IS NOT DISTINCT FROM f.page_id AND c.host = f.host AND c.path = f.path
"""
