"""URL filter: rules first, then a blocked Bloom filter before an exact hash join. DataFrame functions only.

The list of blocked URLs is a table of any size. Its Bloom filter has 256-bit blocks of four 64-bit words; a URL
sets one bit in each word of one block, so that a probe is a lookup of one row and four comparisons. The number of
blocks follows the list up to `MAX_BLOCKS`, which bounds what is broadcast (MAX_BLOCKS rows of five longs, 10 MB);
a longer list only makes more URLs pass to the join, which decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, stage_table

#: Blocks at most: the bound of the broadcast filter.
MAX_BLOCKS = 1 << 18
#: Filter bits for each listed URL, as long as MAX_BLOCKS allows.
BITS_PER_URL = 16


@dataclass(frozen=True)
class Rule:
    """`action` is allow or block; it holds for `host` and its subdomains where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    pattern = r"://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: host without `www.`, path without closing slashes; no query, no fragment."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """`value(rule)` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(value(r))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(4)]


def bloom_filter(listed: DataFrame, column: str = "canonical", max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of `listed` as rows (block, w0..w3) and its number of blocks, at most `max_blocks`."""
    n, blocks = listed.count(), 64
    while blocks * 256 < n * BITS_PER_URL and blocks < max_blocks:
        blocks *= 2
    url = F.col(column)
    rows = listed.select(_block(url, blocks).alias("__block"), *(m.alias(f"__w{j}") for j, m in enumerate(_masks(url))))
    return rows.groupBy("__block").agg(*(F.bit_or(f"__w{j}").alias(f"__w{j}") for j in range(4))), blocks


def filter_urls(pages: DataFrame, blocklist: DataFrame, rules: list[Rule] = (), url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """`pages` with `host`, `path`, `rule` (text of the longest fitting rule or null) and `verdict`.

    The verdict is the rule's; without a rule it is `block` where the canonical URL is in `blocklist` (one string
    column `canonical`, nulls and repeats allowed) and `allow` elsewhere. A null URL or one without `://` has empty
    parts and is never listed, since an empty canonical form is no URL. Rows are kept one for one, repeated rows too;
    an empty blocklist allows all; input columns with the names of results are replaced.
    """
    listed = stage_table(blocklist.select("canonical").where("canonical <> ''").distinct(), "url-list")
    bloom, blocks = bloom_filter(listed, max_blocks=max_blocks)
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # The caller's columns as one, so that none of them meets a column that is made here.
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(0)
    parts = pages.select(whole.alias("page"), host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    url = F.col("__url")
    probed = (
        parts.withColumns({"rule": rule_of(h, p, rules, lambda r: r.text), "__by_rule": rule_of(h, p, rules, lambda r: r.action), "__url": canonical(h, p)})
        .withColumns({"__block": _block(url, blocks)} | {f"__m{j}": m for j, m in enumerate(_masks(url))})
        .join(F.broadcast(bloom), "__block", "left")
    )
    possible = F.col("__by_rule").isNull() & F.col("__w0").isNotNull()
    for j in range(4):
        possible = possible & (F.col(f"__w{j}").bitwiseAND(F.col(f"__m{j}")) == F.col(f"__m{j}"))
    probed = probed.select("page", "host", "path", "rule", "__by_rule", "__url", F.coalesce(possible, F.lit(False)).alias("__possible"))
    out = [*(F.col("page").getField(c).alias(c) for c in kept), "host", "path", "rule"]
    passed = probed.where(~F.col("__possible")).select(*out, F.coalesce("__by_rule", F.lit("allow")).alias("verdict"))
    exact = listed.select(F.col("canonical").alias("__url"), F.lit(True).alias("__listed"))
    judged = probed.where("__possible").join(exact.hint("shuffle_hash"), "__url", "left")
    return passed.unionByName(judged.select(*out, F.when(F.col("__listed"), "block").otherwise("allow").alias("verdict")))
