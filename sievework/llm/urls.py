"""URL filters: rules by host and path, and empirical-Bayes host reputation for what no rule judges.

Pages that a rule judges are the labelled outcomes. Outcomes are counted by host, registered domain and suffix; a
host's user and port don't count, a suffix is the last label, or the last two where ``SUFFIXES`` has them, and a numeric
address is a domain and suffix of its own. From the suffix down, each unit's rate of good outcomes gets a beta prior
around the posterior mean of the unit above it; a level's prior strength comes from how far its units' rates differ
(method of moments for the beta-binomial). A page that no rule judges is blocked if the upper bound of its host's
posterior is under the rate of good outcomes over all: its host is worse than the labelled pages beyond doubt. Everything is
DataFrame functions over ``page_id`` and ``url``; counts are formed before any exchange, and a host with many pages
meets its reputation in a join that can be split.

Results for odd input: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged by the
prior of all outcomes; without any outcome the prior mean is a half with full width, so pages are allowed; repeated rows
are counted and judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import materialize

#: The rules in force: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Width of the bound in standard deviations.
WIDTH = 2.0
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
#: Suffixes of two labels under which domains are registered, the usual ones; any other suffix is a host's last label.
SUFFIXES = tuple(
    f"{x}.{country}"
    for country, kinds in (
        ("uk", "co org ac gov me net ltd plc sch nhs"), ("au", "com net org edu gov id asn"), ("nz", "co net org ac govt school"), ("za", "co org net ac gov web"), ("jp", "co or ne ac ad ed go gr lg"),
        ("kr", "co or ne re pe go ac"), ("in", "co net org ac gov edu res"), ("il", "co org net ac gov"), ("br", "com net org gov edu"), ("mx", "com net org gob edu"), ("ar", "com net org gob edu"), ("co", "com net org gov edu"),
        ("cn", "com net org gov edu ac"), ("hk", "com net org gov edu"), ("tw", "com net org gov edu"), ("sg", "com net org gov edu"), ("my", "com net org gov edu"), ("th", "co or ac go in"), ("id", "co or ac go web"), ("tr", "com net org gov edu"), ("ua", "com net org gov edu"),
    )
    for x in kinds.split()
)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parse(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` and ``path``."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract("url", whole, k), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(part(1), CAPITALS, CAPITALS.lower()).alias("host"), part(2).alias("path"))


def ruled(parsed: DataFrame, rules=RULES) -> DataFrame:
    """With ``rule`` and ``ruling`` of the longest rule that fits, or nulls."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return parsed.withColumns({"rule": rule, "ruling": ruling})


def server(host: Column) -> Column:
    """The host without its user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _address(host: Column) -> tuple[Column, Column]:
    """The server, and whether it is a numeric address."""
    bare = server(host)
    return bare, bare.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def domain(host: Column) -> Column:
    bare, numeric = _address(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(numeric, bare).when(two.isin(*SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix(host: Column) -> Column:
    bare, numeric = _address(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(numeric, bare).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def _strength(units: DataFrame, mean: float) -> float:
    """The prior strength of units with ``good`` of ``n`` outcomes around ``mean``."""
    r = units.where("n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, F.lit(2))).alias("s")).first()
    spread = mean * (1 - mean)
    if not r["k"] or r["k"] < 2 or spread <= 0:
        return MOST_STRENGTH
    room = r["n"] - r["n2"] / r["n"] - (r["k"] - 1)
    share = (r["s"] / spread - (r["k"] - 1)) / room if room > 0 else 1.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - share) / share)) if share > 0 else MOST_STRENGTH


def reputations(pages: DataFrame) -> tuple[DataFrame, float]:
    """``server`` and the ``bound`` of its posterior, for every server, and the rate of good outcomes over all;
    ``pages`` has ``host`` and ``ruling``."""
    judged = F.when(F.col("ruling").isNotNull(), 1)
    hosts = pages.groupBy(server(F.col("host")).alias("server")).agg(F.coalesce(F.sum(judged), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("ruling") == "allow").cast("long")), F.lit(0)).alias("good"))
    hosts = materialize(hosts.withColumns({"domain": domain(F.col("server")), "suffix": suffix(F.col("server"))}), "hosts")
    summed = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*summed), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*summed), "suffixes")
    whole = suffixes.agg(*summed).first()
    mean = ((whole["good"] or 0) + 0.5) / ((whole["n"] or 0) + 1.0)
    posterior = lambda above, strength: (F.col("good") + F.lit(strength) * above) / (F.col("n") + F.lit(strength))
    of_suffix = suffixes.select("suffix", posterior(F.lit(mean), _strength(suffixes, mean)).alias("above"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", posterior(F.col("above"), _strength(domains, mean)).alias("above"))
    strength = _strength(hosts, mean) if whole["n"] else LEAST_STRENGTH
    good = hosts.join(of_domain, "domain").select("server", (F.col("good") + F.lit(strength) * F.col("above")).alias("a"), (F.col("n") - F.col("good") + F.lit(strength) * (1 - F.col("above"))).alias("b"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return good.select("server", (F.col("a") / total + WIDTH * deviation).alias("bound")), mean


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row."""
    known = ruled(parse(pages), rules)
    found, mean = reputations(known)
    bounds = materialize(found, "reputations")
    verdict = F.coalesce("ruling", F.when(F.col("bound") < mean, "block").otherwise("allow"))
    judged = known.withColumn("server", server(F.col("host"))).join(bounds, "server", "left")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


_TWO = ", ".join(f"'{x}'" for x in SUFFIXES)
ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
k(ruling, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT u.*, (SELECT max_by({'rule': h || p, 'ruling': ruling}, length(h || p)) FROM k WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS m FROM u),
r AS (SELECT page_id, host, path, m.rule AS rule, m.ruling AS ruling, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS server FROM f),
g AS (SELECT server, count(ruling)::DOUBLE AS n, count(*) FILTER (ruling = 'allow')::DOUBLE AS g, regexp_matches(server, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') AS numeric, string_split(server, '.') AS part, array_to_string(list_slice(string_split(server, '.'), -2, -1), '.') AS two FROM r GROUP BY server),
h AS (SELECT server, n, g, CASE WHEN numeric THEN server WHEN two IN (@TWO@) THEN array_to_string(list_slice(part, -3, -1), '.') ELSE two END AS domain, CASE WHEN numeric THEN server WHEN two IN (@TWO@) THEN two ELSE part[-1] END AS suffix FROM g),
d AS (SELECT domain, suffix, sum(n) AS n, sum(g) AS g FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY ALL), w AS (SELECT (sum(g) + 0.5) / (sum(n) + 1) AS mean, sum(n) AS whole FROM s),
lv AS (SELECT 'h' AS l, n, g FROM h UNION ALL SELECT 'd', n, g FROM d UNION ALL SELECT 's', n, g FROM s),
q AS (SELECT l, count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room, (sum(n * pow(g / n - mean, 2)) / (mean * (1 - mean)) - (count(*) - 1)) AS extra FROM lv, w WHERE n > 0 GROUP BY l, mean),
z AS (SELECT l, CASE WHEN k < 2 THEN 10000.0 WHEN room <= 0 THEN 1.0 WHEN extra / room > 0 THEN least(10000.0, greatest(1.0, (1 - extra / room) / (extra / room))) ELSE 10000.0 END AS strength FROM q),
st AS (SELECT coalesce((SELECT strength FROM z WHERE l = 'h'), 1.0)::DOUBLE AS zh, coalesce((SELECT strength FROM z WHERE l = 'd'), 10000.0)::DOUBLE AS zd, coalesce((SELECT strength FROM z WHERE l = 's'), 10000.0)::DOUBLE AS zs),
ps AS (SELECT suffix, (g + zs * mean) / (n + zs) AS above FROM s, w, st), pd AS (SELECT domain, (g + zd * above) / (n + zd) AS above FROM d JOIN ps USING (suffix), st),
ab AS (SELECT server, g + zh * above AS a, n - g + zh * (1 - above) AS b FROM h JOIN pd USING (domain), st),
bd AS (SELECT server, a / (a + b) + 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN bound < mean THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN bd USING (server), w
""".replace("@TWO@", _TWO)
