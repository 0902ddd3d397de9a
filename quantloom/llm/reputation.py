"""URL filter by empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host. Beta-binomial priors shrink them down the hierarchy: a host towards its
registered domain, a domain towards its public suffix, a suffix towards all. The strength of each level's prior is estimated
from how much the rates below it differ. A host is blocked when the lower posterior bound of its bad rate is above a limit.

Rules given by hand come first. Null urls and urls without :// have an empty host and path; they, unlabelled hosts and empty
tables all get a verdict from what stands above them. Repeated rows are judged one by one, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import stored

#: A host is blocked when even this bound of its bad rate, in standard deviations below the mean, exceeds the limit.
DEVIATIONS, LIMIT = 1.645, 0.25
#: Prior strengths stay within these.
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Copies of the host table that a hot host's pages are dealt over.
SALTS = 16
#: Public suffixes of two labels (fixed values); any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "co.za", "com.cn", "com.mx", "com.tr", "co.kr")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule `host/path-prefix` that fits, and what it says; null where none does."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(rules[text])).otherwise(says)
    return rule, says


def with_domain(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and public suffix of `host`; a port is left out, an address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    labels = F.split(F.regexp_replace(bare, r"\.+$", ""), r"\.")
    n = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*SUFFIXES), 2).otherwise(1)
    address = bare.rlike(r"^[0-9.]+$|\[")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return hosts.select("*", F.when(address, bare).otherwise(last(n + 1)).alias("domain"), F.when(address, F.lit("")).otherwise(last(n)).alias("suffix"))


def _strength(children: DataFrame) -> Column:
    """Moment estimate of a prior's strength from children (n, bad, prior mean): less spread than chance, more strength."""
    spread = F.sum(F.col("n") * F.pow(F.try_divide(F.col("bad"), F.col("n")) - F.col("mean"), 2))
    chance = F.sum(F.col("mean") * (1 - F.col("mean")))
    room = F.sum((F.col("n") - 1) * F.col("mean") * (1 - F.col("mean")))
    overlap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(spread - chance, room)))
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(F.try_divide(1 - overlap, overlap), F.lit(STRONGEST))))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, a, b, rate, bound) from (host, n, bad): posterior Beta(a, b) of the host's bad rate."""
    hosts = stored(with_domain(hosts), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("mean"))

    def shrunk(children: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
        joined = children.join(parents, on) if on else children.crossJoin(F.broadcast(parents))  # no keys: one row
        strength = joined.where("n > 0").agg(_strength(joined).alias("strength"))
        out = joined.crossJoin(F.broadcast(strength))  # one row
        a, b = F.col("bad") + F.col("strength") * F.col("mean"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("mean"))
        return out.select(*[c for c in children.columns if c not in ("a", "b")], a.alias("a"), b.alias("b"), (a / (a + b)).alias(name))

    top = shrunk(suffixes, everything, [], "rate").select("suffix", F.col("rate").alias("mean"))
    middle = shrunk(domains, top, ["suffix"], "rate").select("domain", "suffix", F.col("rate").alias("mean"))
    out = shrunk(hosts, middle, ["domain", "suffix"], "rate")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("a") + F.col("b") + 1))
    return out.withColumn("bound", F.greatest(F.lit(0.0), F.col("rate") - DEVIATIONS * sd))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and bound of every page; `outcomes` (page_id, bad 0/1) labels some."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    labelled = pages.select("page_id", "host").join(known, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    judged = reputation(hosts).select("host", "rate", "bound", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    out = salted.join(judged, ["host", "salt"]).withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(says, method).alias("verdict"), "rate", "bound")
