"""URL filter by Bloom filter cascades: exact membership of listed keys over the corpus's own keys, without joins.

A rule is (host, path, verdict): it fits its host and all subdomains, if the url's path starts with the rule's.
Every url has a few keys: for each (labels in the host, characters in the path) that some rule has, the url's own
suffix and prefix of that size, and the words of its host.  A key is looked up in two cascades, one of the keys to
block and one of the keys to allow.

A cascade is exact over the universe of all keys of the corpus.  Level 1 is a Bloom filter of the listed keys; level 2
holds the other keys of the universe that level 1 takes for listed; level 3 the listed keys that level 2 takes for
those; and so on until a level takes nothing wrongly.  A key is listed if the first level that does not know it has an
even number, or if all know it and their number is odd.  Level 1 takes about 0.7 other keys for each listed one, later
levels half of what they are asked, so a cascade of n keys holds some ``n * log2(universe / n)`` bits, times a small
factor: its size follows the lists, not the corpus.

To build, the urls are read twice (an approximate count of the universe; the keys that level 1 takes, distinct per
task before they are shuffled).  A level's bits come from ``bitmap_construct_agg`` and go into the plan as one binary
literal.  Lists whose level 1 would pass ``max_bytes`` are cut by the hash of the key into shards, each with cascades
of its own; the urls then pass one written round per shard.  All of it is DataFrame functions.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; the longest
fitting rule wins (its host and path together, then its host), and if it is in both lists it blocks; a url that no rule
fits is blocked if a word of its host is listed, else allowed; rules with a null column are ignored; rows are judged
one by one, so repeated or null page_ids and other columns do no harm; empty tables and empty lists are allowed.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.session import write_table

#: The rules of the registered query, (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words of hosts that sell, bet or show what a text corpus does not want.
HOST_WORDS = ["adult", "bet", "bets", "betting", "bingo", "cams", "casino", "casinos", "cialis", "escort", "escorts",
              "hentai", "jackpot", "lottery", "nude", "payday", "pills", "poker", "porn", "roulette", "sex", "slots",
              "viagra", "warez", "xxx"]

HASHES = 6
#: Bits of one bitmap of bitmap_construct_agg.
PAGE_BITS = 32_768
#: Bytes of level 1 of a cascade; longer lists are cut into shards.
MAX_BYTES = 32 << 20


def _lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


@dataclass
class Cascade:
    """The levels, (bits in the level, its bytes), of one shard of a list of keys."""

    levels: list[tuple[int, bytes]]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            found = F.when(_known(key, k, *self.levels[k - 1]), found).otherwise(F.lit(k % 2 == 0))
        return found


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _known(key: Column, level: int, bits: int, data: bytes) -> Column:
    """Whether all of a key's bits are set in a level."""
    out = F.lit(True)
    for i in range(HASHES):
        place = _place(key, level, i, bits)
        byte = F.conv(F.hex(F.substr(F.lit(data), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1)
    return out


def _bits(keys: int, share: float) -> int:
    """Bits of a Bloom filter of so many keys that takes about ``share`` of other keys, in whole bitmaps."""
    bits = -HASHES * max(keys, 1) / math.log(1 - min(share, 0.5) ** (1 / HASHES))
    return PAGE_BITS * math.ceil(bits / PAGE_BITS) if bits > PAGE_BITS else max(64, math.ceil(bits))


def _level(keys: DataFrame, level: int, bits: int) -> tuple[int, bytes]:
    """The Bloom filter of the keys; each of its pages is a partial aggregate, and only the pages reach the driver."""
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("p"))
    pages = places.groupBy(F.floor(F.col("p") / PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("p") % PAGE_BITS).alias("bitmap"))
    data = bytearray(PAGE_BITS // 8 * math.ceil(bits / PAGE_BITS))
    for r in pages.collect():
        data[PAGE_BITS // 8 * r["page"]:PAGE_BITS // 8 * (r["page"] + 1)] = r["bitmap"]
    return bits, bytes(data[:math.ceil(bits / 8)])


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, share: float | None = None) -> Cascade:
    """The cascade of the keys (column key) of ``listed``, exact over them and the keys of ``universe``, which may
    repeat.  ``share``: of other keys that level 1 takes; by default as many as make later levels small."""
    asked = write_table(listed.where("key is not null").distinct(), "listed")
    n = asked.count()
    if not n:
        return Cascade([])
    bits = _bits(n, min(0.5, n / (math.sqrt(2) * max(n_universe, 1))) if share is None else share)
    levels = [_level(asked, 1, bits)]
    taken = universe.where("key is not null").where(_known(F.col("key"), 1, *levels[0])).distinct()
    flagged = taken.withColumn("own", F.lit(0)).unionByName(asked.withColumn("own", F.lit(1)))
    wrong = write_table(flagged.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "taken")
    while n := wrong.count():
        k = len(levels) + 1
        levels.append(_level(wrong, k, _bits(n, 0.5)))
        asked, wrong = wrong, write_table(asked.where(_known(F.col("key"), k, *levels[-1])), "taken")
    return Cascade(levels)


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels of the host, characters of the path) of the rules, few however many rules there are."""
    sizes = rules.select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars")).distinct()
    return sorted((r["labels"], r["chars"]) for r in sizes.collect())


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All keys of a url, each once: array of struct(length, host_length, key); a word of the host has length 0."""
    kind = "array<struct<length:int,host_length:int,key:string>>"
    sizes = F.expr(f"array({', '.join(f'struct({d} as labels, {n} as chars)' for d, n in shapes)})")
    labels = F.size(F.split(host, "\\."))
    fitting = F.filter(sizes, lambda s: (labels >= s["labels"]) & (F.length(path) >= s["chars"])) if shapes else None
    rules = F.lit(None).cast(kind) if fitting is None else F.transform(F.transform(
        fitting, lambda s: F.struct(F.call_function("substring_index", host, F.lit("."), -s["labels"]).alias("h"),
                                    F.substr(path, F.lit(1), s["chars"]).alias("p"))), lambda x: F.struct(
            (F.length(x["h"]) + F.length(x["p"])).alias("length"), F.length(x["h"]).alias("host_length"),
            F.concat(x["h"], x["p"]).alias("key")))
    words = F.array_distinct(F.filter(F.split(host, "[^0-9a-z]+"), lambda w: w != ""))
    named = F.transform(words, lambda w: F.struct(F.lit(0).alias("length"), F.lit(0).alias("host_length"),
                                                  F.concat(F.lit("word "), w).alias("key")))
    return F.concat(F.coalesce(rules, F.expr(f"cast(array() as {kind})")), named.cast(kind))


def judge_urls(pages: DataFrame, rules: DataFrame, words: DataFrame, share: float | None = None,
               max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (host and path, or null), verdict (allow or block).

    ``rules``: (host, path, verdict); ``words``: (word), blocked where no rule fits.
    """
    rules = write_table(rules.dropna(subset=["host", "path", "verdict"]).select(_lower(F.col("host")).alias("host"), "path", "verdict")
                        .distinct(), "rules")
    shapes = _shapes(rules)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", _keys(F.col("host"), F.col("path"), shapes))
    universe = urls.select(F.explode("keys.key").alias("key"))
    named = rules.select("verdict", F.concat("host", "path").alias("key")).unionByName(
        words.dropna().select(F.lit("block").alias("verdict"), F.concat(F.lit("word "), "word").alias("key"))).distinct()
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    n_shards = math.ceil(_bits(named.count(), min(0.5, 1 / max(n_universe, 1))) / 8 / max_bytes)
    shard = lambda key: F.pmod(F.xxhash64(key), F.lit(n_shards))
    kind = "array<struct<length:int,host_length:int,blocks:boolean,key:string>>"
    urls = urls.withColumn("found", F.expr(f"cast(array() as {kind})"))
    for s in range(n_shards):
        part = universe.where(shard(F.col("key")) == s)
        block, allow = (build_cascade(named.where((F.col("verdict") == v) & (shard(F.col("key")) == s)).select("key"),
                                      part, -(-n_universe // n_shards), share) for v in ("block", "allow"))
        judged = F.transform(F.filter("keys", lambda x: shard(x["key"]) == s), lambda x: F.struct(
            x["length"], x["host_length"], block.contains(x["key"]).alias("blocks"),
            (allow.contains(x["key"])).alias("allows"), x["key"].alias("key")))
        listed = F.transform(F.filter(judged, lambda x: x["blocks"] | x["allows"]), lambda x: F.struct(
            x["length"].alias("length"), x["host_length"].alias("host_length"), x["blocks"].alias("blocks"), x["key"].alias("key")))
        urls = urls.withColumn("found", F.concat("found", listed.cast(kind)))
        urls = write_table(urls, "judged") if s + 1 < n_shards else urls
    best = urls.select("page_id", "host", "path", F.array_max("found").alias("best"))
    return best.select("page_id", "host", "path", F.when(F.col("best.length") > 0, F.col("best.key")).alias("rule"),
                       F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))
