"""URL filter: a blocked Bloom filter before an exact hash join.

The list holds canonical URLs as (host, path) prefixes. A URL probes one key for
each host suffix it belongs to and each path length that the list uses. The keys
pass a blocked Bloom filter (one 512-bit block a key, held as eight 64-bit words)
that is small enough to broadcast; only keys that pass go on to the exact join,
which removes false positives and brings the rule. The filter never exceeds
``MAX_BLOOM_BYTES``; on a longer list it lets more keys through to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOOM_BYTES = 64 << 20
BITS_PER_KEY = 16
PROBES = 6  # bits set in a key's block

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Host names listed as unwanted, under each of the top-level names.
UNWANTED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
TOPS = ("com", "net", "org")


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty without ``://``; only A-Z of the host is lowered."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"(?s)^([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def listed_table(spark: SparkSession) -> DataFrame:
    """The unwanted hosts as listed URLs: every path below them."""
    rows = [(f"{h}.example.{t}", "/") for h in UNWANTED for t in TOPS]
    return spark.createDataFrame(rows, "host string, path string")


def host_suffixes(host: Column) -> Column:
    """A host and each domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )


def key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x00"), path)


def bloom_bits(k: Column) -> tuple[Column, list[Column]]:
    """Hash of a key that picks the block, and its bits as eight masks."""
    a, b = F.xxhash64(k), F.xxhash64(k, F.lit(1))
    bits = [F.pmod(F.shiftrightunsigned(b, 9 * i), F.lit(512)) for i in range(PROBES)]
    masks = []
    for word in range(8):
        mask = F.lit(0).cast("long")
        for bit in bits:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.floor(bit / 64) == word, one).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return a, masks


def build_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row a block that has bits: ``block`` and words ``w0`` to ``w7``."""
    a, masks = bloom_bits(F.col("__key"))
    return (
        listed.select(F.pmod(a, F.lit(blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    )


def match_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed prefix that decides each of the distinct (host, path) of ``urls``.

    ``listed`` has host, path, verdict and ``rank``; the highest rank wins, then
    most characters of host and path together, then the longer host. Of entries
    with the same rank, host and path ``block`` wins. Returns host, path and the
    struct ``hit`` for URLs that some entry fits.
    """
    keyed = (
        listed.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(key(F.col("host"), F.col("path")).alias("__key"))
        .agg(F.max(F.struct("rank", F.length(F.concat("host", "path")), F.length("host"), "verdict", "host", "path")).alias("entry"))
    )
    facts = keyed.agg(F.count("*").alias("n"), F.collect_set(F.length("entry.path")).alias("lengths")).first()
    lengths = F.array(*[F.lit(n) for n in sorted(facts["lengths"])]).cast("array<int>")
    suffixed = urls.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("__suffix"))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    probes = suffixed.select(
        "host",
        "path",
        F.explode(
            F.transform(fitting, lambda n: key(F.col("__suffix"), F.substr(F.col("path"), F.lit(1), n)))
        ).alias("__key"),
    )
    blocks = max(1, -(-facts["n"] * BITS_PER_KEY // 512))
    blocks = min(blocks, MAX_BLOOM_BYTES // 72)
    a, masks = bloom_bits(F.col("__key"))
    bloom = F.broadcast(build_bloom(keyed, blocks))  # at most MAX_BLOOM_BYTES
    probes = probes.withColumn("block", F.pmod(a, F.lit(blocks))).join(bloom, "block")
    for i, m in enumerate(masks):
        probes = probes.where(F.col(f"w{i}").bitwiseAND(m) == m)
    probes = probes.select("host", "path", "__key")
    return probes.join(keyed, "__key").groupBy("host", "path").agg(F.max("entry").alias("hit"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Judge every row's URL: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides; a URL that none fits is blocked when a
    listed canonical URL is a prefix of it and allowed otherwise. Null URLs, and
    those without ``://``, have an empty host and path: no rule fits them and they
    are allowed. Equal URLs are judged once and joined back, so a hot URL is one
    row of the search; repeated rows and null ids are kept; an empty list allows.
    """
    host, path = canonical(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    entries = rules.select("host", "path", "verdict", F.lit(1).alias("rank")).unionByName(
        listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(0).alias("rank"))
    )
    found = match_list(judged.select("host", "path").where("host != ''").distinct(), entries)
    own = F.col("hit.rank") == 1
    return judged.join(found, ["host", "path"], "left").select(
        id_col,
        "host",
        "path",
        F.when(own, F.concat("hit.host", "hit.path")).alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.lit("allow")).alias("verdict"),
    )


def oracle() -> str:
    """DuckDB SQL for the query over ``pages``."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    listed = ", ".join(f"('{h}.example.{t}')" for h in UNWANTED for t in TOPS)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
), judged AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0, 's') AS path FROM hosts
), rules(verdict, host, path) AS (VALUES {rules}), listed(host) AS (VALUES {listed}),
fits AS (
  SELECT j.host, j.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM judged) j
  JOIN rules r ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
  GROUP BY 1, 2
)
SELECT j.page_id, j.host, j.path, f.rule,
       CASE WHEN f.verdict IS NOT NULL THEN f.verdict
            WHEN starts_with(j.path, '/') AND EXISTS (
              SELECT 1 FROM listed l WHERE j.host = l.host OR ends_with(j.host, '.' || l.host)) THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN fits f ON j.host = f.host AND j.path = f.path
"""
