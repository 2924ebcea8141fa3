"""URL filters: rules on host and path, and a Bloom filter cascade of listed hosts.

The listed hosts are a table. The cascade answers membership of a key exactly
for a known universe: level 0 encodes the listed keys; level 1 encodes the other
keys of the universe that level 0 wrongly accepts; level 2 the listed keys that
level 1 wrongly accepts, and so on until no key is left. A key's answer is the
parity of the first level that rejects it. The universe are all hosts of the
corpus, so pages are judged by bit tests against the filters, without a join.

The bits of a level are set in tasks and combined by words; the filters go to
the tasks as binary arrays. Their size is known before they are built:
BITS_PER_KEY bits for each encoded key. Where a level would exceed what is left
of MAX_BYTES, some ten million listed hosts, keys and pages are dealt by a hash
of the host into parts, each judged by a cascade of its own, one part after
another; a part that is still too large is dealt again. So neither the driver
nor a task ever holds more than MAX_BYTES of filters.

The list may come from any table (host). Two sources are at hand: hosts with a
listed label, and hosts of which a tenth of the pages or more is junk, which no
url tells: symbols in runs of three make up a fiftieth of a junk page's text.

Defined results: a null url, or one without `://`, has an empty host and path,
which can be listed like any other; a host listed twice is listed; of rules of
equal length the later one wins; very long urls and repeated rows are judged like
others; a null or empty html is no junk, and very long ones are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Tables, mix

#: (host, path, verdict); the longest fitting rule wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels of hosts that put them on the list.
LISTED_LABELS = ("casino", "casino-win", "bet", "bets", "free-bets", "poker", "slots", "jackpot", "win")
BITS_PER_KEY, HASHES, MAX_LEVELS = 12, 5, 64
MAX_BYTES = 16 << 20
#: Parts of at most so many listed keys aren't dealt again, whatever the bound.
LEAST_KEYS = 16
#: A page is junk if runs of symbols are at least one in so many characters of its text; a host is, if one in so many of its pages are.
JUNK_TEXT, JUNK_PAGES = 50, 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first `://` and `/`, `?`, `#` or the end, in ASCII lower case; path from there to `?`, `#` or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def listed_label(host: Column, labels=LISTED_LABELS) -> Column:
    """Whether a label of the host, or a part of it between hyphens, is listed."""
    parts = F.concat(F.split(host, r"\."), F.split(host, r"[.-]"))
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in labels]))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key, F.lit(k)).alias(f"_h{k}") for k in (0, 1)]


def _spots(one: np.ndarray, two: np.ndarray, level: int, bits: int) -> np.ndarray:
    """(HASHES x n) bit positions in a level's filter, from two hashes of each key."""
    a, b = (mix(x.view(np.uint64) + np.uint64(0x9E3779B9 * (2 * level + k + 1))) for k, x in enumerate((one, two)))
    return np.stack([(a + np.uint64(j) * (b | np.uint64(1))) % np.uint64(bits) for j in range(HASHES)])


def _accepts(one: np.ndarray, two: np.ndarray, level: int, words: np.ndarray) -> np.ndarray:
    at = _spots(one, two, level, 64 * len(words))
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1).all(0)


class Cascade:
    """Levels of 64-bit words; `contains` is exact for every key of the universe it was built from."""

    def __init__(self, spark, levels: list[np.ndarray]):
        self.levels = levels
        self._sent = spark.sparkContext.broadcast(levels)

    def contains(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Adds the boolean column `name`: whether the key is listed."""
        sent, names = self._sent, rows.columns

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = sent.value
            for part in batches:
                one, two = (np.asarray(part.column(len(names) + k), np.int64) for k in (0, 1))
                answer, open_ = np.zeros(len(one), bool), np.ones(len(one), bool)
                for level, words in enumerate(levels):
                    passed = _accepts(one, two, level, words)
                    answer[open_ & ~passed] = level % 2 == 1
                    open_ &= passed
                answer[open_] = len(levels) % 2 == 1
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(answer)], [*names, name])

        out = rows.select("*", *_hashes(F.col(key)))
        return out.mapInArrow(test, rows.withColumn(name, F.lit(True)).schema)


def build_cascade(universe: DataFrame, key: str = "key", listed: str = "listed", max_bytes: int | None = MAX_BYTES) -> Cascade | None:
    """The cascade of the keys with `listed` true; None if it would exceed `max_bytes`."""
    spark = universe.sparkSession
    tables = Tables(spark)
    wrong = tables.keep(universe.select(*_hashes(F.col(key)), F.col(listed).alias("listed")), "keys")
    levels: list[np.ndarray] = []
    encode = True
    for level in range(MAX_LEVELS):
        own = wrong.where(F.col("listed") == encode)
        n = own.count()
        if not n and level:
            return Cascade(spark, levels)
        size = max(1, -(-n * BITS_PER_KEY // 64))
        if max_bytes is not None and 8 * (sum(map(len, levels)) + size) > max_bytes:
            return None

        def fill(batches: Iterator[pa.RecordBatch], level=level, size=size) -> Iterator[pa.RecordBatch]:
            for part in batches:
                at = _spots(*(np.asarray(part.column(k), np.int64) for k in (0, 1)), level, 64 * size).reshape(-1)
                word, where = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"])

        filled = own.select("_h0", "_h1").mapInArrow(fill, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        got = filled.toArrow()  # `size` rows at most
        words = np.zeros(size, np.uint64)
        words[np.asarray(got.column("word"))] = np.asarray(got.column("bits"), np.int64).view(np.uint64)
        levels.append(words)
        sent = spark.sparkContext.broadcast(words)

        def accepted(batches: Iterator[pa.RecordBatch], level=level, sent=sent) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield part.filter(pa.array(_accepts(*(np.asarray(part.column(k), np.int64) for k in (0, 1)), level, sent.value)))

        # Keys of the other kind that this level accepts, and its own, which the next level may accept wrongly.
        wrong = tables.keep(wrong.mapInArrow(accepted, wrong.schema), f"level{level}")
        if not wrong.where(F.col("listed") != encode).count():
            return Cascade(spark, levels)
        encode = not encode
    return None


def listed_hosts(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """(host): the hosts of the pages that have a listed label."""
    return pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct().where(listed_label(F.col("host"), labels))


def junk_hosts(pages: DataFrame) -> DataFrame:
    """(host): the hosts of which a tenth of the pages or more is junk."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^<>]*>", " ")
    marks = F.length(text) - F.length(F.regexp_replace(text, "[%#*]{3}", ""))
    junk = (marks > 0) & (marks * JUNK_TEXT >= F.length(text))
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host"), junk.alias("junk")).groupBy("host")
    return hosts.agg(F.count(F.lit(1)).alias("n"), F.count_if("junk").alias("bad")).where(F.col("bad") * JUNK_PAGES >= F.col("n")).select("host")


def with_listed(rows: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES, depth: int = 0) -> DataFrame:
    """`rows` (host, ...) with the boolean `is_listed`, by cascades of `universe` (key, listed), which holds every host of the rows."""
    cascade = build_cascade(universe, max_bytes=max_bytes)
    if cascade is not None:
        return cascade.contains(rows, "host", "is_listed")
    n = universe.where("listed").count()
    if n <= LEAST_KEYS:
        return build_cascade(universe, max_bytes=None).contains(rows, "host", "is_listed")
    # Twice the room that the listed keys need, as the further levels need some too.
    parts = min(max(2, -(-2 * n * BITS_PER_KEY // (8 * max(max_bytes, 1)))), 1 + n // LEAST_KEYS)
    # Other levels of dealing take other hashes.
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(f"part {depth}")), F.lit(parts)).alias("_part")
    tables = Tables(rows.sparkSession)
    keys = tables.keep_parts(universe.select("*", part("key")), "keys", "_part")
    dealt = tables.keep_parts(rows.select("*", part("host")), "rows", "_part")
    done = []
    for k in range(parts):
        mine = with_listed(dealt.where(F.col("_part") == k).drop("_part"), keys.where(F.col("_part") == k).drop("_part"), max_bytes, depth + 1)
        done.append(tables.keep(mine, f"done/part={k}"))
    tables.forget("keys", "rows")
    return rows.sparkSession.read.schema(done[0].schema).parquet(*[f"{tables.folder}/done/part={k}" for k in range(parts)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the rule's verdict, else block for a host of `listed` (host) and allow for others."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    blocked = listed.select(F.col("host").cast("string").alias("key")).distinct().withColumn("listed", F.lit(True))
    universe = rows.select(F.col("host").alias("key")).distinct().join(blocked, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    judged = with_listed(rows, universe, max_bytes)
    judged = judged.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


ORACLE = """
WITH texts AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '<[^<>]*>', ' ', 'g') AS text FROM pages
), parts AS (
  SELECT page_id, length(text) AS size, length(text) - length(regexp_replace(text, '[%#*]{3}', '', 'g')) AS marks, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM texts
), split AS (
  SELECT page_id, size, marks, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM split
), junk AS (
  SELECT host FROM split GROUP BY host HAVING 10 * count(*) FILTER (marks > 0 AND 50 * marks >= size) >= count(*)
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host IN (SELECT host FROM junk) THEN 'block'
    WHEN list_has_any(list_concat(string_split(host, '.'), string_split(replace(host, '-', '.'), '.')),
         ['casino', 'casino-win', 'bet', 'bets', 'free-bets', 'poker', 'slots', 'jackpot', 'win']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
