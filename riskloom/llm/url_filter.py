"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into one multiword bit vector. A rule of m characters
takes m + 1 states; a ``*`` is a self-loop on the state before it, so one step for
an input byte is ``(D & loops) | ((D << 1) & mask[byte])`` for every rule at once
(a nondeterministic Shift-And automaton). NumPy runs that step for a whole batch of
URLs; lanes are sorted by length so that finished URLs drop out of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_rows, own_columns

#: Between host and path in the scanned bytes; no UTF-8 text contains it.
SEP = b"\xff"

#: (verdict, host, path): the rule fits its host and every subdomain, under that path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Host globs that block where no rule fits.
HOST_GLOBS = ("*casino*", "*adult*", "*porn*", "*xxx*", "*spam*", "*pills*", "*viagra*", "*-bets*", "*ads-track*")


@dataclass
class Automaton:
    """Masks of the packed rules; ``*`` is any run of bytes and ``?`` any one byte."""

    masks: np.ndarray  # (256, words)
    loops: np.ndarray  # (words,)
    start: np.ndarray  # (words,)
    finals: list[tuple[int, np.uint64]]  # word and bit of each rule's last state

    @classmethod
    def of(cls, globs: list[bytes]) -> Automaton:
        states = sum(len(g.replace(b"*", b"")) + 1 for g in globs)
        words = states // 64 + 1
        masks, loops, start = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        finals, at = [], 0
        for g in globs:
            start[at >> 6] |= np.uint64(1 << (at & 63))
            for c in g:
                if c == ord("*"):
                    loops[at >> 6] |= np.uint64(1 << (at & 63))
                    continue
                at += 1
                bit = np.uint64(1 << (at & 63))
                if c == ord("?"):
                    masks[:, at >> 6] |= bit
                else:
                    masks[c, at >> 6] |= bit
            finals.append((at >> 6, np.uint64(1 << (at & 63))))
            at += 1
        return cls(masks, loops, start, finals)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(texts, rules) booleans: whether the rule matches the whole text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes, flat = sizes[order], np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        d = np.repeat(self.start[None], len(texts), 0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for i in range(int(sizes[0]) if live else 0):
            while live and sizes[live - 1] <= i:
                live -= 1
            now = d[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= self.masks[flat[begin[:live] + i]]
            now &= self.loops
            now |= moved
        hit = np.stack([(d[:, w] & bit) != 0 for w, bit in self.finals], 1)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((p for c in "?#" if (p := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


def url_filter(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, host_globs=HOST_GLOBS) -> DataFrame:
    """One row per input row: key, host, path, rule (null if none fits), verdict.

    The longest fitting rule decides (host and path length together, then the
    earlier rule); otherwise a matching host glob blocks and all else is allowed.
    Null and empty URLs and URLs without ``://`` have an empty host and path, so no
    rule fits and they are allowed. Repeated rows are judged alike; an empty table
    gives an empty result; other columns are not read. Nothing is shuffled.
    """
    own_columns(key, ["host", "path", "rule", "verdict"])
    rules, names = tuple(rules), [h + p for _, h, p in rules]
    globs: list[bytes] = []
    for _, host, path in rules:
        globs += [host.encode() + SEP + path.encode() + b"*", b"*." + host.encode() + SEP + path.encode() + b"*"]
    globs += [g.encode() + SEP + b"*" for g in host_globs]
    automaton = Automaton.of(globs)
    rank = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [split_url(u) for u in pdf[url]]
        hit = automaton.match([h.encode() + SEP + p.encode() for h, p in parts])
        rule = np.full(len(parts), -1)
        for i in reversed(rank):
            rule[hit[:, 2 * i] | hit[:, 2 * i + 1]] = i
        bad = hit[:, 2 * len(rules):].any(1)
        return pd.DataFrame({
            key: pdf[key],
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [names[i] if i >= 0 else None for i in rule],
            "verdict": [rules[i][0] if i >= 0 else "block" if b else "allow" for i, b in zip(rule, bad)],
        })

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, url), f"`{key}` {kind}, host string, path string, rule string, verdict string", judge)


def oracle() -> str:
    """The same verdicts as SQL."""
    path = "regexp_replace(regexp_replace(rest, '[?#].*$', '', 's'), '^[^/]*', '')"
    host = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    bad = " OR ".join(f"contains(host, '{g.strip('*')}')" for g in HOST_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, {host} AS host, {path} AS path FROM parts)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {says} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict
FROM named"""
