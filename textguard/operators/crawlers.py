"""Verification of crawler claims in access logs: does the address belong to who the user agent says?"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Claim, pattern of the user agent, key of the published ranges (None: none are published). The first match counts.
CLAIMS = [
    ("ChatGPT-User (answer time)", r"chatgpt-user", "openai_user"),
    ("OAI-SearchBot (index)", r"oai-searchbot", "openai_search"),
    ("GPTBot (training)", r"gptbot", "openai_train"),
    ("Claude-User (answer time)", r"claude-user", "anthropic"),
    ("Claude-SearchBot (index)", r"claude-searchbot", "anthropic"),
    ("ClaudeBot (training)", r"claudebot|claude-web|anthropic-ai", "anthropic"),
    ("DuckAssistBot (answer time)", r"duckassistbot", "duckduckgo"),
    ("DuckDuckBot (search)", r"duckduckbot", "duckduckgo"),
    ("Perplexity-User (answer time)", r"perplexity-user", "perplexity_user"),
    ("PerplexityBot (index)", r"perplexitybot", "perplexity_bot"),
    ("Amazonbot (no list published)", r"amazonbot", None),
    ("Cohere (no list published)", r"cohere-ai|cohere-training", None),
    ("Meta AI (no list published)", r"meta-externalagent|meta-externalfetcher", None),
]


def claim_of(agent: Column, field: int = 0) -> Column:
    """Claim (field 0) or key of its ranges (field 2) of a user agent; null if it claims nothing."""
    out = F.lit(None).cast("string")
    for claim in reversed(CLAIMS):
        out = F.when(F.rlike(agent, F.lit(f"(?i){claim[1]}")), F.lit(claim[field]).cast("string")).otherwise(out)
    return out


def address_bits(text: str | None) -> str | None:
    """Version and bits of an address; null if it is none."""
    try:
        address = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return f"{address.version}{int(address):0{address.max_prefixlen}b}"


def network_bits(text: str | None) -> str | None:
    """Version and leading bits that all addresses of a network share; null if it is none, or has bits set behind its prefix."""
    try:
        network = ipaddress.ip_network((text or "").strip())
    except ValueError:
        return None
    return address_bits(str(network.network_address))[: 1 + network.prefixlen]


def _mapped(text: Column, of) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(each, StringType())(text)


def prefixes_of(networks: DataFrame) -> DataFrame:
    """Distinct (vendor, prefix) of networks (vendor, cidr). A vendor with a network that cannot be read has none: its list cannot be trusted."""
    read = networks.select("vendor", _mapped(F.col("cidr"), network_bits).alias("prefix")).distinct()
    void = read.where("prefix is null").select("vendor").distinct()
    return read.join(void, "vendor", "left_anti")


def inside_networks(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct (vendor, bits) of ``addresses`` that lie in a network (vendor, prefix) of their vendor.

    A network is a prefix of its addresses' bits. An address has one prefix of each length in use (at most 33 and 129 of
    the two versions), so an equi-join finds them: nested networks cost no more than others, and the
    addresses of a vendor with most of the traffic are spread by their prefixes.
    """
    kinds = prefixes.select(F.substring("prefix", 1, 1).alias("version"), F.char_length("prefix").alias("size")).distinct().collect()
    sizes = {v: sorted(k["size"] for k in kinds if k["version"] == v) for v in ("4", "6")}
    lengths = F.when(F.startswith("bits", F.lit("4")), F.array(*map(F.lit, sizes["4"]))).otherwise(F.array(*map(F.lit, sizes["6"])))
    keyed = addresses.select("vendor", "bits", F.explode(lengths.cast("array<int>")).alias("size"))
    keyed = keyed.select("vendor", "bits", F.substring("bits", F.lit(1), F.col("size")).alias("prefix"))
    return keyed.join(prefixes, ["vendor", "prefix"], "left_semi").select("vendor", "bits").distinct()


#: Names under which the published lists keep their networks.
PREFIX_KEYS = ("ipv4Prefix", "ipv6Prefix")


def strings_under(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(key columns, value) of all strings that stand under one of the names ``keys`` at any depth of a column ``tree`` (VARIANT).

    Each level of the trees is one generator over the containers of the level above, until none is left; what stands under a
    wanted name without being a string is searched on. The other columns of ``documents`` are carried along. Levels
    are kept only while the search runs; the result, which stays cached, is what was found.
    """
    carried = [c for c in documents.columns if c != "tree"]
    kind = F.schema_of_variant("node")
    container = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    level = documents.select(*carried, F.lit(None).cast("string").alias("name"), F.col("tree").alias("node")).where("tree is not null")
    found, levels, spark = None, [], documents.sparkSession
    while True:
        level = level.withColumn("kind", kind).withColumn("inner", container).persist()
        levels.append(level)
        hits = level.where(F.col("name").isin(list(keys)) & (F.col("kind") == "STRING")).select(*carried, F.try_variant_get("node", "$", "string").alias("value"))
        found = hits if found is None else found.unionByName(hits)
        above = level.where("inner").select(*carried, "node")
        if above.isEmpty():
            break
        opened = above.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level = opened.select(*carried, F.col("key").alias("name"), F.col("value").alias("node"))
    found = found.persist()
    found.count()
    for level in levels:
        level.unpersist()
    return found


def read_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(vendor, cidr) of the JSON files below ``folder``, one for each vendor and named by it; prefixes may lie at any depth.

    A file that is no JSON gives a null network, which voids its vendor.
    """
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("vendor"), F.try_parse_json("value").alias("tree"))
    broken = files.where("tree is null").select("vendor", F.lit(None).cast("string").alias("cidr"))
    return strings_under(files, PREFIX_KEYS).select("vendor", F.col("value").alias("cidr")).unionByName(broken)


def judge_claims(log: DataFrame, networks: DataFrame) -> DataFrame:
    """(claim, ip, n, verdict) of the requests (ip, user_agent) that claim something.

    Uncheckable is a claim whose vendor has no list, or one that is void; fake is any address outside
    the list, one that cannot be read included. Requests of equal claim and address are counted first, so that each meets the networks once.
    """
    agent = F.col("user_agent")
    claimed = log.select("ip", claim_of(agent).alias("claim"), claim_of(agent, 2).alias("vendor")).where("claim is not null")
    counted = claimed.groupBy("claim", "vendor", "ip").agg(F.count("*").alias("n")).withColumn("bits", _mapped(F.col("ip"), address_bits))
    wanted = [c[2] for c in CLAIMS if c[2]]
    prefixes = prefixes_of(networks.where(F.col("vendor").isin(wanted)))
    # a row for each key of the fixed table of claims at most
    known = F.broadcast(prefixes.select("vendor").distinct().withColumn("known", F.lit(True)))
    inside = inside_networks(counted.where("bits is not null").select("vendor", "bits").distinct(), prefixes).withColumn("ok", F.lit(True))
    verdict = F.when(F.col("known").isNull(), "uncheckable").when(F.col("ok"), "verified").otherwise("fake")
    return counted.join(known, "vendor", "left").join(inside, ["vendor", "bits"], "left").select("claim", "ip", "n", verdict.alias("verdict"))


def verify_claims(log: DataFrame, networks: DataFrame) -> DataFrame:
    """Per claim and over all ('all'): numbers of requests that are verified, fake and uncheckable."""
    total = lambda k: F.sum(F.when(F.col("verdict") == k, F.col("n")).otherwise(0)).alias(k)
    rolled = judge_claims(log, networks).rollup("claim").agg(total("verified"), total("fake"), total("uncheckable"))
    return rolled.select(F.coalesce("claim", F.lit("all")).alias("claim"), *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("verified", "fake", "uncheckable")])


def by_total(claims: DataFrame) -> DataFrame:
    """Result of verify_claims with total and place: the most frequent claim first, equal ones by name, the sum of all last."""
    total = F.col("verified") + F.col("fake") + F.col("uncheckable")
    # a row for each of at most 13 claims, so one task may order them
    order = Window.orderBy(F.col("claim") == "all", F.desc("total"), "claim")
    return claims.withColumn("total", total).withColumn("place", F.row_number().over(order).cast("long"))


def fake_addresses(log: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, requests, claims): addresses of fake requests with their number and the names claimed, most frequent first.

    A name is a claim up to its first blank; there are at most 13, so the sets are small.
    """
    fake = judge_claims(log, networks).where("verdict = 'fake'")
    names = F.array_sort(F.collect_set(F.split_part("claim", F.lit(" "), F.lit(1))))
    return fake.groupBy("ip").agg(F.sum("n").alias("requests"), names.alias("claims")).orderBy(F.desc("requests"), "ip")


def shared_addresses(log: DataFrame, networks: DataFrame) -> DataFrame:
    """Fake addresses that claim more than one name."""
    return fake_addresses(log, networks).where(F.size("claims") > 1)
