"""URL filter by rules and by empirical-Bayes host reputation (operator 9).

Labelled page outcomes (bad or not) are counted by host, by registered domain and by suffix. Each level's rates are shrunk
towards the level above: a beta prior has the parent's posterior mean, and its strength comes from how much the rates of
that level scatter beyond chance (method of moments for the beta-binomial). A host is blocked when the lower bound of its
posterior rate of bad pages reaches a limit, so a host with few labels is judged by its domain. Rules come first: the
longest one that fits a URL decides.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import cut

#: Bounds of the correlation of outcomes within a group, so that a prior counts as 1 to 999 pages.
RHO = (0.001, 0.5)


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Public suffixes of two labels (the last label is one anyway); a longer list may be given.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk",
    "com.mx", "com.my", "com.ng", "com.pe", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.in", "go.jp", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk",
)


#: The rules that the registered query applies.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.

    The suffix is the last label, or one of ``suffixes``, the domain one label more. An IP address is its own domain and
    suffix, so it is shrunk to the rate of all pages alone.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.$", "")
    address = bare.rlike(r"^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    labels = F.split(bare, r"\.")
    part = lambda k: F.array_join(F.slice(labels, -F.least(k, F.size(labels)), F.least(k, F.size(labels))), ".")
    n = F.lit(1)
    for k in sorted({x.count(".") + 1 for x in suffixes}):
        n = F.when(part(F.lit(k)).isin([x for x in suffixes if x.count(".") + 1 == k]), F.lit(k)).otherwise(n)
    return F.when(address, bare).otherwise(part(n + 1)), F.when(address, bare).otherwise(part(n))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls; of two equally long ones the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame) -> float:
    """Pages that a prior of this level is worth, from columns n, bad and m (the parent's rate)."""
    spread = F.col("m") * (1 - F.col("m"))
    excess = F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * spread)
    row = groups.where("n > 1").agg(excess.alias("x"), F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("y")).first()
    rho = min(max((row.x or 0.0) / row.y, RHO[0]), RHO[1]) if row.y else RHO[0]
    return (1 - rho) / rho


def reputation(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host from rows (host, bad: 0, 1 or null): host, n, bad, rate, lower, upper.

    What comes to the driver is one row of sums for each level. Null host: the host ``""``. Without any outcome every rate
    is one half with the widest prior. ``lower`` and ``upper`` are bounds by the normal approximation of the beta posterior.
    Hosts that differ in user or port alone are hosts of their own, of one domain.
    """
    rows = outcomes.select(F.coalesce("host", F.lit("")).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = cut(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    parent, mean = None, F.lit(((total.bad or 0) + 0.5) / ((total.n or 0) + 1))
    for level, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        if level == "host":
            groups = hosts
        else:
            groups = hosts.groupBy(*([level, above] if above else [level])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("m", mean) if parent is None else groups.join(parent, above)
        s = F.lit(_strength(groups))
        groups = groups.withColumns({"rate": (F.col("bad") + s * F.col("m")) / (F.col("n") + s), "weight": F.col("n") + s})
        parent = groups.select(level, F.col("rate").alias("m"))
    half = F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return groups.select("host", "n", "bad", "rate", (F.col("rate") - half).alias("lower"), (F.col("rate") + half).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Every page's page_id, host, path, rule and verdict.

    ``outcomes`` has rows (page_key, bad), joined to ``pages.page_key``; a page may have none. Repeated outcomes of a key
    count once, as the worst. Hosts whose posterior rate of bad pages is at least ``limit`` at the lower bound are blocked
    where no rule fits. Null url, or one without ``://``: host and path are empty, and so is the host of its reputation.
    Null page_id and repeated rows: each row is judged. Empty table: no rows. Very long urls count whole. Other columns, of
    pages and of outcomes, are not read, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "page_key", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_key is not null and bad is not null").groupBy("page_key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    posterior = reputation(rows.join(known, "page_key", "left"), z, suffixes)
    blocked = posterior.where(F.col("lower") >= limit).select("host", F.lit(True).alias("blocked"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(blocked, "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
