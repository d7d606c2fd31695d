"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A URL's host is what follows its first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; the path follows up to "?", "#" or the end, the query from "?" up to "#".
A null URL, or one without "://", has an empty host and path. The canonical form is "." host "#" path query, in which bytes past ASCII are written as %XX: "#" occurs once, so
a rule can tell host from path, and a host's suffix begins with a dot.

A rule is an action and a glob over the whole canonical form: "*" any run, "?" any byte, "[a-z]" and "[!a-z]" classes, "\\" before a byte that stands for itself. Each place in a glob is a bit;
a "*" lets the bit before it stay. A text's byte moves all bits of all rules by one shift, one mask and one more mask for the bits that stay. Of the rules that fit, the one of
the smallest tier wins, in it the one with the longest name, then the first of the list. A URL that no rule fits is allowed.

Rows are independent: there is no shuffle, and a task holds one Arrow batch, the masks and a block of state words. Repeated rows get equal answers, null ids are kept, an empty table gives no
rows, other columns are not read, and a very long URL is read whole, a byte at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trim, utf8

#: State words of a block of URLs, and masks of a block of rules, are held below this many bytes.
STATE_BYTES = 8 << 20
MASK_BYTES = 8 << 20
FIELDS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    glob: str
    name: str
    tier: int = 0


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?[]\\" else c for c in text)


def site(action: str, host: str, path: str, tier: int = 0) -> Rule:
    """A rule for a host and its subdomains, under the beginning of a path."""
    return Rule(action, f"*.{escaped(host)}#{escaped(path)}*", host + path, tier)


#: Rules that come first (fixed values).
SITES = (site("block", "net", "/"), site("allow", "example.net", "/en/"), site("block", "example.com", "/de/"), site("allow", "org", "/fr/"))

#: Words that begin a part of a bad site's host, and paths of no use to a corpus (fixed values).
HOST_WORDS = ("casino", "poker", "jackpot", "free-bets", "bets-", "cheap-pills", "pills-", "viagra", "adult-", "xxx", "porn", "escort", "spam-", "ads-", "adserver", "doubleclick", "tracker", "payday-loan", "warez", "torrent")
PATHS = ("/wp-login*", "/wp-admin/*", "/cgi-bin/*", "/cart/*", "/checkout/*", "*.exe", "*.zip", "*.apk", "*[?&]sessionid=*", "*[?&]phpsessid=*")
WORDS = (*(Rule("block", f"*[.-]{escaped(w)}*#*", f"host:{w}", 1) for w in HOST_WORDS), *(Rule("block", f"*#{p}", f"path:{p}", 1) for p in PATHS))


def atoms(glob: str) -> tuple[list[np.ndarray], list[bool]]:
    """The byte sets of a glob's places, and for each place, and the start before them, whether a "*" follows."""
    raw, sets, stay, i = utf8(glob), [], [False], 0
    while i < len(raw):
        c, i = raw[i : i + 1], i + 1
        if c == b"*":
            stay[-1] = True
            continue
        hit = np.zeros(256, bool)
        end = raw.find(b"]", i + (2 if raw[i : i + 1] == b"!" else 1)) if c == b"[" else -1
        if c == b"?":
            hit[:] = True
        elif end > 0:
            inner, i = raw[i:end], end + 1
            out = inner[:1] == b"!"
            inner = inner[out:]
            k = 0
            while k < len(inner):
                last = inner[k + 2] if inner[k + 1 : k + 2] == b"-" and k + 2 < len(inner) else inner[k]
                hit[inner[k] : last + 1] = True
                k += 3 if inner[k + 1 : k + 2] == b"-" and k + 2 < len(inner) else 1
            if out:
                hit = ~hit
        else:
            if c == b"\\" and i < len(raw):
                c, i = raw[i : i + 1], i + 1
            hit[c[0]] = True
        sets.append(hit)
        stay.append(False)
    return sets, stay


class Automaton:
    """Rules in the order given, packed over words of 64 bits; find() gives the first that fits each text, or their number."""

    def __init__(self, globs: list[str]):
        parts = [atoms(g) for g in globs]
        n = sum(len(s) + 1 for s, _ in parts)
        self.words = -(-n // 64)
        bits = np.zeros((256, self.words * 64), bool)
        start, stays, self.last = np.zeros(self.words * 64, bool), np.zeros(self.words * 64, bool), np.zeros(len(parts), np.int64)
        at = 0
        for k, (sets, stay) in enumerate(parts):
            start[at] = True
            stays[at : at + len(stay)] = stay
            for j, hit in enumerate(sets):
                bits[:, at + j + 1] = hit
            self.last[k] = at + len(sets)
            at += len(sets) + 1
        pack = lambda b: np.packbits(b, axis=-1, bitorder="little").view("<u8")
        self.masks, self.start, self.stay = pack(bits), pack(start), pack(stays)

    def find(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """raw: the texts' bytes; a text begins at its start. Texts are stepped together, the longest first, so those that have ended drop off the end."""
        order = np.argsort(-sizes, kind="stable")
        out = np.full(len(sizes), len(self.last), np.int64)
        step = max(1, STATE_BYTES // (8 * self.words))
        word, bit = self.last >> 6, (self.last & 63).astype(np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for lo in range(0, len(order), step):
            rows = order[lo : lo + step]
            at, size = starts[rows], sizes[rows]
            state = np.repeat(self.start[None], len(rows), axis=0)
            live = len(rows)
            for p in range(int(size[0]) if len(size) else 0):
                while live and size[live - 1] <= p:
                    live -= 1
                now = state[:live]
                moved = now << one
                moved[:, 1:] |= now[:, :-1] >> top
                state[:live] = (moved & self.masks[raw[at[:live] + p]]) | (now & self.stay)
            fits = (state[:, word] >> bit) & one
            some = fits.any(axis=1)
            out[rows[some]] = fits[some].argmax(axis=1)
        return out


def compiled(rules: list[Rule]) -> tuple[list[Rule], list[Automaton]]:
    """The rules, the one that wins first, and their automata: blocks of rules whose masks stay below MASK_BYTES."""
    ranked = [r for _, r in sorted(enumerate(rules), key=lambda x: (x[1].tier, -len(x[1].name), x[0]))]
    out, block, bits = [], [], 0
    for r in ranked:
        size = len(utf8(r.glob)) + 1
        if block and (bits + size) * 32 > MASK_BYTES:
            out.append(Automaton(block))
            block, bits = [], 0
        block.append(r.glob)
        bits += size
    return ranked, out + [Automaton(block)] if block else out


def fields(url: Column) -> list[Column]:
    """Host, path and query of a URL."""
    part = lambda k: F.coalesce(F.regexp_extract(url, FIELDS, k), F.lit(""))
    return [F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"), part(3).alias("query")]


def canonical(host: str, path: str, query: str) -> bytes:
    text = f".{host}#{path}{query}"
    return text.encode() if text.isascii() else b"".join(b"%%%02X" % c if c > 127 else bytes((c,)) for c in utf8(text))


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule: name of the rule that decides, tier, action): null rule and tier, and "allow", where none fits. The rules are the caller's, compiled once on the driver."""
    ranked, automata = compiled(list(rules))
    kind = df.schema[id_col].dataType.simpleString()
    urls = df.select(F.col(id_col).alias("id"), *fields(F.col(url_col).cast("string")))
    names, tiers, actions = (pa.array([getattr(r, c) for r in ranked], t) for c, t in (("name", pa.string()), ("tier", pa.int32()), ("action", pa.string())))

    def run(batches):
        for batch in batches:
            host, path, query = (batch.column(k) for k in (1, 2, 3))
            texts = [canonical(*x) for x in zip(host.to_pylist(), path.to_pylist(), query.to_pylist(), strict=True)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            raw, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
            won, base, open_ = np.full(len(texts), -1, np.int64), 0, np.arange(len(texts))
            for a in automata:  # a later block decides only for what no earlier one fits
                hit = a.find(raw, starts[open_], sizes[open_])
                fits = hit < len(a.last)
                won[open_[fits]] = base + hit[fits]
                open_, base = open_[~fits], base + len(a.last)
            take = pa.array(won, mask=won < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), host, path, names.take(take), tiers.take(take), actions.take(take).fill_null("allow")], ["id", "host", "path", "rule", "tier", "action"])
        trim()

    return urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, tier int, action string")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages"), [*SITES, *WORDS])
    return found.select(F.col("id").alias("page_id"), "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), F.col("action").alias("verdict"), F.when(F.col("tier") > 0, F.col("rule")).alias("method_rule"))
