"""URL filter rules by a sort-merge range join (operator 8).

A host's canonical key is its labels in reverse, each ended by ``\\x00``; a rule's host becomes the interval
of keys that start with its key, which holds the host and all subdomains. URLs and rules are dealt to key
ranges, sorted together and swept once: a stack holds the hosts of the active, nested rules of the current key with
their paths by length, and the longest rule whose path starts the URL's path wins.

Range bounds come from a bounded sample of keys (as Spark's own range partitioner does) and include a row
hash, so that one hot URL spreads over several ranges. A rule goes to each range that its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.tables import table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT_VERDICT = "allow"
SAMPLES_PER_RANGE = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; null or no ``://``: empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x00"), F.lit("\x00"))


class _Level:
    """The rules of one host key: the longest path that starts a URL's path is found by a look-up per length of path."""

    def __init__(self, part: int, key: str, host: str):
        self.part, self.key, self.host = part, key, host
        self.verdict_of: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        self.verdict_of[path] = max(verdict, self.verdict_of.get(path, verdict))
        at = bisect_left(self.lengths, len(path))
        if self.lengths[at : at + 1] != [len(path)]:
            self.lengths.insert(at, len(path))

    def longest(self, path: str) -> str | None:
        for n in reversed(self.lengths[: bisect_right(self.lengths, len(path))]):
            if path[:n] in self.verdict_of:
                return path[:n]
        return None


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, kind): rules (kind 0) come before the URLs (kind 1) of the same key."""
    stack: list[_Level] = []
    for batch in batches:
        rules, verdicts, keep = [], [], []
        rows = zip(*(batch[c].to_pylist() for c in ("part", "key", "kind", "host", "path", "verdict")), strict=True)
        for i, (part, key, kind, host, path, verdict) in enumerate(rows):
            while stack and not (stack[-1].part == part and key.startswith(stack[-1].key)):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Level(part, key, host))
                stack[-1].add(path, verdict)
                continue
            best = None
            for level in stack:
                p = level.longest(path)
                if p is not None and (best is None or (len(level.host) + len(p), len(level.host)) > best[0]):
                    best = ((len(level.host) + len(p), len(level.host)), level.host + p, level.verdict_of[p])
            keep.append(i)
            rules.append(best and best[1])
            verdicts.append(best[2] if best else default)
        if keep:
            out = batch.select(["id", "host", "path"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, ranges: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``id, host, path, rule, verdict``; rule is null where none fits.

    ``rules``: verdict, host, path. The longest host + path wins; of equal length the longer host, then
    ``block`` before ``allow``. Repeated rows, null ids and null URLs are judged like any other row; an empty
    rule table gives every URL the default; other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = df.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    # the tie-breaker spreads rows of one hot host; a rule's own key has none and so sorts before them
    mark = F.concat("key", F.lpad(F.hex(F.xxhash64("path", "id")), 16, "0"))
    urls = urls.withColumn("mark", mark)
    bounds = _bounds(urls, ranges)
    place = _placer(bounds)
    of_urls = urls.select(place(F.col("mark")).alias("part"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), "id")
    keyed = rules.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
    spread = F.explode(F.sequence(place(F.col("key")), place(F.concat("key", F.lit("\U0010ffff")))))
    null_id = F.lit(None).cast(df.schema[id_col].dataType)
    of_rules = keyed.select(spread.alias("part"), "key", F.lit(0).alias("kind"), "host", "path", "verdict", null_id.alias("id"))
    both = of_urls.unionByName(of_rules).repartitionById(max(ranges, 1), F.col("part")).sortWithinPartitions("part", "key", "kind")
    kind = df.schema[id_col].dataType.simpleString()
    return both.mapInArrow(lambda it: _sweep(it, default), f"id {kind}, host string, path string, rule string, verdict string")


def _placer(bounds: list[str]):
    """How many bounds are at or below a key, by binary search; strings compare as UTF-8 bytes, as Spark sorts them."""
    ends = [b.encode() for b in bounds]

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(ends, k) for k in keys.cast(pa.binary()).to_pylist()], pa.int32())

    return place


def _bounds(urls: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys that part the URLs evenly, from at most about ``ranges * SAMPLES_PER_RANGE`` sampled keys."""
    wanted = ranges * SAMPLES_PER_RANGE
    total = urls.count()
    sample = urls.select("mark") if total <= wanted else urls.select("mark").sample(fraction=wanted / total, seed=7)
    marks = sorted((r[0] for r in sample.collect()), key=str.encode)
    picks = [marks[i * len(marks) // ranges] for i in range(1, ranges)] if marks else []
    return sorted(set(picks), key=str.encode)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the contract's rules; a null url is judged as empty."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    found = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b AS (SELECT page_id, host, path,
             (SELECT max({'n': length(h) + length(p), 'hn': length(h), 'v': v, 'r': h || p}) FROM r
              WHERE (u.host = h OR suffix(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM b
"""
