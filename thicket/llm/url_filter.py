"""URL filters: host and path rules, then a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (a parameter; the default is `LABELLED`
below, some thousand urls made by rule from two word lists, modifiers that both have, and made-up names) and becomes an array literal of `BUCKETS` weights.
Scoring is one narrow projection of built-in functions: no shuffle, no Python on the executors.

An n-gram's bucket is its CRC-32 modulo `BUCKETS`. N-grams come from the host between ^ and $ marks and from the path;
each distinct one counts once.

Defined cases: a null url or one without `://` has host and path empty, no rule, and the verdict of the
model on the empty string. Rules match their host and its subdomains if the path starts with the rule's;
the longest rule wins, an allow before a block of equal length. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, table, unpack

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: Log-odds of a url that says nothing: such a url is let through.
PRIOR = -1.0
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words from which the default labelled table is made: what unwanted sites call themselves, ordinary words, and what either is combined with.
UNWANTED = "casino poker bet bets betting bookie slots jackpot lottery roulette gambling adult xxx sex porn erotic escort camgirls spam linkfarm pills viagra pharma steroids ads adserver adclick tracker clickbait popunder banners warez torrent crack keygen serials replica payday loans quickcash bitcoins forex".split()
ORDINARY = (
    "news journal library university school museum garden kitchen recipes history science weather travel music cinema forum wiki archive docs city council hospital theatre football chess "
    "mountain river harbour bakery studio workshop research institute gallery press radio daily thread thing station nation action edition option motion nature ocean planet family health "
    "village bridge castle forest island letter number people picture question reason record season sister brother student subject summer winter system teacher theory thunder together "
    "tradition translation transport understanding village vision voice water window winter writing yellow adventure address advice advance admiral spanish space special pilot pillar "
    "sextant essex bethany better between alphabet diabetes cashmere loaned crackle popular porcelain slotted trackside clicker banner trading shipping strength length month north south "
    "earth mother father other another rather their thanks that these those three through thought brothers shore fish british english fashion relation position condition tension mission"
).split()
MODIFIERS = "online best top club zone world shop house net hub live plus star gold king mega super pro city land direct group base one".split()
_SITES = ("com", "org", "net", "test")
_PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}", "/es/{}/", "/en/{}/", "/de/{}", "/{}.html")


def made_up(k: int) -> str:
    """A name without meaning, of two to five syllables."""
    syllables = [c + v + e for c in "b d f g k l m n p r s t v w h th sh st tr".split() for v in "aeiou" for e in ("", "n", "r", "l", "s", "th")]
    return "".join(syllables[zlib.crc32(b"%d %d" % (k, i)) % len(syllables)] for i in range(2 + k % 4))


def hosts(words: Sequence[str], k: int) -> list[str]:
    """Names of sites about the k-th word: alone, and with modifiers or made-up names before or after."""
    word, mods = words[k], [MODIFIERS[(k * 5 + i * 7) % len(MODIFIERS)] for i in range(4)]
    short = [made_up(4 * (zlib.crc32(word.encode()) + i))[: 3 + i % 3] for i in range(4)]
    return [word, f"{word}-{mods[0]}", f"{mods[1]}-{word}", f"{word}{mods[2]}", f"{mods[3]}{word}", f"{word}-{short[0]}", f"{short[1]}-{word}", f"{word}{short[2]}", f"{short[3]}{word}"]


def make_labelled(unwanted: Sequence[str] = UNWANTED, ordinary: Sequence[str] = ORDINARY, names: range = range(900)) -> tuple[tuple[str, int], ...]:
    """(url, 1 if unwanted) by rule: every name under several hosts and paths, which so tell nothing about the label."""
    rows, k = [], 0
    sites = [(1, h) for i in range(len(unwanted)) for h in hosts(unwanted, i)] + [(0, h) for i in range(len(ordinary)) for h in hosts(ordinary, i)] + [(0, made_up(i)) for i in names]
    for y, name in sites:
        for prefix in ("", "www.", "blog.", "m.") if y else ("", "www.", "blog.", "m.")[zlib.crc32(name.encode()) % 4 :][:1]:
            k += 1
            rows.append((f"https://{prefix}{name}.example.{_SITES[k * 7 % 4]}{_PATHS[k * 5 % 8].format(k * 7919 % 50000)}", y))
    return tuple(rows)


LABELLED = make_labelled()


def split_url(url: str | None) -> tuple[str, str]:
    """Plain Python form of `host_column` and `path_column`, for the small labelled table."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def gram_buckets(host: str, path: str) -> set[int]:
    marked = (f"^{host}$", path)
    return {zlib.crc32(s[i : i + n].encode()) % BUCKETS for s in marked for n in GRAMS for i in range(len(s) - n + 1)}


def train(labelled: Iterable[tuple[str, int]], epochs: int = 25, rate: float = 1.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """Logistic regression by stochastic gradient steps in a fixed order. Returns bucket weights and the fixed bias."""
    rows = [(sorted(gram_buckets(*split_url(u))), y) for u, y in labelled]
    order = sorted(range(len(rows)), key=lambda k: zlib.crc32(b"%d" % k))
    weights, bias = [0.0] * BUCKETS, PRIOR
    for epoch in range(epochs):
        step = rate / (1 + epoch / 10)
        for k in range(len(rows)):
            grams, y = rows[order[k]]
            scale = 1 / math.sqrt(max(1, len(grams)))
            z = bias + scale * sum(weights[g] for g in grams)
            slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            for g in grams:
                weights[g] -= step * (slope * scale + decay * weights[g])
    return weights, bias


def host_column(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, n: int) -> Column:
    """Array of the n-grams of a text; a text shorter than n has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def probability(host: Column, path: Column, weights: Sequence[float], bias: float) -> Column:
    table_of = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into a literal
    buckets = F.array_distinct(F.transform(F.concat(*(_grams(s, n) for s in (F.concat(F.lit("^"), host, F.lit("$")), path) for n in GRAMS)), lambda g: (F.crc32(g.cast("binary")) % BUCKETS).cast("int")))
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table_of, b))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.lit(1), F.size(buckets))))))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Iterable[tuple[str, int]] = LABELLED) -> DataFrame:
    """pages: page_id, url, any more. Returns page_id, host, path, rule, verdict, probability (of being unwanted) and the others."""
    weights, bias = train(labelled)
    parts = pack(pages, "page_id", "url").withColumns({"host": host_column(F.col("url")), "path": path_column(F.col("url"))})
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(hit, F.lit(h + p)).otherwise(rule), F.when(hit, F.lit(kind)).otherwise(verdict)
    scored = parts.withColumns({"rule": rule, "probability": probability(host, path, weights, bias)})
    scored = scored.withColumn("verdict", F.coalesce(verdict, F.when(F.col("probability") >= 0.5, "block").otherwise("allow")))
    return unpack(scored, "page_id", "url", "host", "path", "rule", "verdict", "probability")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "probability")
