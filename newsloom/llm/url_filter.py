"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages are summed by host, registered domain and suffix. A suffix's
rate of bad pages is shrunk towards the rate of all, a domain's towards its suffix's, a
host's towards its domain's: each by a beta-binomial prior whose mean is the parent's
posterior mean and whose strength comes from the spread between units of that level
(method of moments). A host is blocked when the lower bound of its posterior, ``z``
standard deviations below the mean, is above ``most_bad``. Explicit rules come first.

Only DataFrame functions run here. Pages travel as (id, host), labels as counts; sums
combine on the map side, and the verdicts that return to the pages are one row a host,
joined so that Spark can split a host with a third of all pages. The counts of hosts are
written once and all three levels derive from them.

Suffixes under which names are registered come as a table of their own (any number of
labels each; the longest that fits counts); without one, a host's last label is its suffix.

Defined cases: a null url, or one without ``://``, has empty host and path and takes part
as host ''; null labels don't count; a page may have several labels, and repeated pages
count as often as they stand; hosts without labels get their domain's rate; no labels at
all: nothing is blocked by reputation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import let, materialize

@dataclass(frozen=True)
class Reputation:
    z: float = 1.645
    most_bad: float = 0.5
    #: Bounds of the intraclass correlation that sets a prior's strength.
    least_spread: float = 0.005
    most_spread: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


_ADDRESS = r"^(\d+\.){3}\d+$"


def bare_host(host: Column) -> Column:
    """A host without port and final dot."""
    return F.regexp_replace(host, r"\.?(:\d*)?$", "")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row a host) with domain, the suffix and one label more, and suffix.

    ``suffixes``: a table with a column ``suffix``. A host of no more labels than its suffix
    stands for itself under suffix '', and so does an address.
    """
    named = hosts.withColumn("bare", bare_host(F.col("host")))
    labels = F.when(named["bare"].rlike(_ADDRESS), F.array(F.col("bare"))).otherwise(F.split("bare", r"\."))
    named = named.withColumn("labels", labels)
    known = F.lit(1)
    if suffixes is not None:
        tails = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda n: F.struct(F.array_join(F.slice("labels", -n, n), ".").alias("tail"), n.alias("n")))
        fits = named.where(F.size("labels") > 1).select("host", F.inline(tails))
        fits = fits.join(suffixes.select(F.col("suffix").alias("tail")).distinct(), "tail").groupBy(F.col("host").alias("_h")).agg(F.max("n").alias("_n"))
        named = named.join(fits, F.col("host").eqNullSafe(F.col("_h")), "left")
        known = F.coalesce("_n", F.lit(1))
    enough = F.size("labels") > known
    last = lambda n: let(n, lambda k: F.array_join(F.slice(F.col("labels"), -k, k), "."))
    domain = F.when(enough, last(known + 1)).otherwise(F.col("bare"))
    return named.select(*hosts.columns, domain.alias("domain"), F.when(enough, last(known)).otherwise(F.lit("")).alias("suffix"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        on, _, below = rule.partition("/")
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit("/" + below))
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def _spread(units: DataFrame, r: Reputation) -> DataFrame:
    """One row: the prior strength that fits these units."""
    mean = F.sum("bad") / F.sum("n")
    labelled = units.where("n > 0")
    sums = labelled.agg(
        mean.alias("m"), F.count("*").alias("c"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("k2")
    )
    noise = F.col("m") * (1 - F.col("m"))
    above = (F.col("k2") - F.col("nn") * F.col("m") * F.col("m")) - noise * (F.col("c") - 1)
    room = noise * (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("c") - 1))
    rho = F.least(F.lit(r.most_spread), F.greatest(F.lit(r.least_spread), F.coalesce(F.when(room > 0, above / room), F.lit(r.least_spread))))
    return sums.select((1 / rho - 1).alias("strength"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, r: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, posterior, lower, blocked) of every host.

    ``pages``: page_id, host. ``outcomes``: page_id, bad (boolean; null doesn't count).
    """
    per_page = outcomes.where("bad is not null").groupBy(F.col("page_id").alias("o")).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = (
        pages.join(per_page, F.col("page_id") == F.col("o"), "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("bad"))
    )
    hosts = materialize(with_domains(hosts, suffixes), "hosts")
    total = lambda: (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*total()), "domains")
    suffix_totals = materialize(domains.groupBy("suffix").agg(*total()), "suffixes")
    whole = suffix_totals.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("prior"))

    def shrunk(units: DataFrame) -> DataFrame:
        a = F.col("strength") * F.col("prior") + F.col("bad")
        b = F.col("strength") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
        # one row: a cross join with it adds no rows
        return units.join(_spread(units, r)).withColumn("a", a).withColumn("b", b).withColumn("posterior", F.col("a") / (F.col("a") + F.col("b")))

    s = shrunk(suffix_totals.join(whole)).select(F.col("suffix").alias("s"), F.col("posterior").alias("prior"))
    d = shrunk(domains.join(s, F.col("suffix") == F.col("s"))).select(F.col("domain").alias("d"), F.col("suffix").alias("s"), F.col("posterior").alias("prior"))
    size = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return (
        shrunk(hosts.join(d, (F.col("domain") == F.col("d")) & (F.col("suffix") == F.col("s"))))
        .withColumn("lower", F.col("posterior") - r.z * sd)
        .select("host", "n", "bad", "posterior", "lower", (F.col("lower") > r.most_bad).alias("blocked"))
    )


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    r: Reputation = Reputation(),
    suffixes: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), posterior, lower."""
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = host_reputation(parts.select("page_id", "host"), outcomes, r, suffixes).select(F.col("host").alias("h"), "posterior", "lower", "blocked")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    return parts.join(known, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "posterior", "lower",
    )
